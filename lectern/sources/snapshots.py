"""Snapshot tables: versions of a table as folders, with a pointer to the current one. Readers see a whole version or the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotTable:
    """A table under `path`. Plain Parquet has no row-level change, so a change is a new version.

    `current` holds one row a commit, written last by Spark's own committer; the newest names the version to read. A writer that dies before
    its commit leaves an unused folder and no other trace. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version string, at timestamp, no long").parquet(f"{self.path}/current")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def version(self) -> str | None:
        commits = self._commits()
        row = commits.orderBy(F.desc("no")).first() if commits is not None else None
        return row["version"] if row else None

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/versions/{v}") if v else None

    def replace(self, df: DataFrame, *partition_by: str) -> str:
        """Write `df` as the next version; `df` may read the present one."""
        v = uuid.uuid4().hex
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/versions/{v}")
        commits = self._commits()
        no = (commits.agg(F.max("no")).first()[0] or 0) + 1 if commits is not None else 1
        self.spark.sql(f"SELECT '{v}' AS version, current_timestamp() AS at, {no}L AS no").write.mode("append").parquet(f"{self.path}/current")
        return v

    def upsert(self, new: DataFrame, key: str) -> str:
        from lectern.operators.records import upserted

        old = self.read()
        return self.replace(new if old is None else upserted(old, new, key))


def exported(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write a set of tables under one folder; name and rows of each, counted from what was written."""
    spark, counts = None, None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(f"{path}/{name}")
        row = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        counts = row if counts is None else counts.unionByName(row)
    return counts


def imported(spark: SparkSession, path: str, names: list[str], into: dict[str, SnapshotTable]) -> bool:
    """Load exported tables where nothing is indexed yet; False leaves all as it is."""
    if any((t := into[n].read()) is not None and not t.isEmpty() for n in names):
        return False
    for n in names:
        into[n].replace(spark.read.parquet(f"{path}/{n}"))
    return True
