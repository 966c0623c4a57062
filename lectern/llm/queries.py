"""The queries of this subpackage: op1_ to op13_, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, divergence, knn_quality, merkle, mixing, ngram_join, piece_sampling, quality_rules, secret_scan, sharding, site_tree, transcripts, warc
from lectern.llm.queries_sql import ORACLE
from lectern.session import shared_dir, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_groups(table(spark, sf_dir, "documents"), ngram_join.Rule(k=3, percent=90))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.fit_on(docs, table(spark, sf_dir, "labels")))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = warc.records(warc.read(spark, archive))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written from all conversations; the model learns from four fifths of them, all are parsed."""
    written = transcripts.as_transcript(table(spark, sf_dir, "conversations"))
    lines = transcripts.lines_of(written, "conv_id", ["turn"], "text", "role")
    model = transcripts.fit(lines.filter(F.crc32(F.col("_key").cast("string").cast("binary")) % 5 != 0))
    found = transcripts.turns(transcripts.parse(lines, model))
    return found.select(F.col("_key").alias("conv_id"), "turn", "role", "n_lines", transcripts.rendered(F.col("role"), F.col("text")).alias("rendered"))


def op7_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    space = knn_quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return knn_quality.score(docs, space).select("doc_id", knn_quality.held_out().alias("held_out"), "score", (F.col("score") >= knn_quality.THRESHOLD).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_columns(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_tree.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.digests(table(spark, sf_dir, "documents"), piece_sampling.load())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document names one source here, so every pattern is a source and every network one arc; the rows come through the flow all the same."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all documents is tampered with; each is checked against the root of the untouched table."""
    m = merkle.build(table(spark, sf_dir, "documents"), changes=merkle.lower_every_third("doc_id", "text"))
    return merkle.audit(m).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
