"""From raw documents to sampled pieces: five stages, each over all that the one before kept.

Every stage is written as Parquet to the folder that the executors share and read again, so a lost executor repeats no earlier stage.
Near copies are documents whose sets of five-word shingles have a similarity of 0.8 or more.

Defined results: null and empty texts fail the first stage; a null id is a key of its own in every stage, and links nothing; of repeated rows, and of texts with equal
shingles, one row with the smallest id stays; one id on different texts is decided text by text; nulls in other columns, and columns of any name, pass through (a
column piece_ids gives way in the last stage); an empty table gives an empty result. Folders of stages stay under spark.checkpoint.dir for whoever cleans that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, ngram_join, piece_sampling, quality_rules, secret_scan
from lectern.llm.clashes import filtered, fresh
from lectern.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line model is fitted on a bounded sample of labelled ones."""
    model = quality_rules.fit_on(docs, table(spark, sf_dir, "labels"))
    return filtered(docs, quality_rules.RESULTS, lambda d: quality_rules.judge(d, model, with_text=True), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return ngram_join.one_of_each(docs, ngram_join.Rule(k=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, and no whole shorter item, with the benchmark."""
    items = table(spark, sf_dir, "benchmark")
    return filtered(docs, decontaminate.RESULTS, lambda d: decontaminate.find(d, items, carry=d.columns), "n_hit = 0")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced; n_chars follows the text where it changed."""
    before = fresh("_chars", docs.columns)
    clean = secret_scan.redact(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the sampled piece ids, which decode to the text."""
    return piece_sampling.encode(docs, piece_sampling.load()).drop("text")


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("sentencepiece sampling", pieces),
]

#: The line model and the sampled pieces are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
