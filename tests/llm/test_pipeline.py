"""The pipeline on the smallest tables against plain Python, stage by stage."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from lectern.llm import ngram_join, piece_sampling, quality_rules
from tests.llm import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "n_chars").cache()
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality_rules.fit_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, model).collect()}
    kept = [i for i, r in rows.items() if verdict[i]]
    assert not any(brute.quality(rows[i]["text"])["base_failed"] for i in kept)
    comp = brute.components({i: rows[i]["text"] for i in kept}, 5, 80)
    kept = [i for i in kept if comp[i][1] == i]
    items = {str(r[0]): r[1] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    bad = brute.contamination({i: rows[i]["text"] for i in kept}, items)
    kept = [i for i in kept if not bad[i][-1]]
    out = piece_sampling.decode(P.run(spark, sf), piece_sampling.load()).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(kept)
    for r in out:
        text = rows[r["doc_id"]]["text"]
        assert r["n_chars"] == len(r["decoded"])
        assert not brute.secrets(r["decoded"])
        # what stays is the text around the marks
        parts = map(re.escape, r["decoded"].split("[SECRET]"))
        assert re.fullmatch(".+?".join(parts), text, re.S)
        assert ("[SECRET]" in r["decoded"]) >= bool(brute.secrets(text))


def test_odd_rows(spark, sf):
    """Nulls in any column, repeated rows, empty and long texts pass every stage."""
    good = " ".join(f"Word{chr(97 + i)} and some{chr(97 + i)} thing{chr(122 - i)} went on{chr(97 + i)}." for i in range(26))
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (None, good + " more", None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, " ".join(f"w{i}" for i in range(60_000)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        docs.count()
        if "text" in docs.columns:
            assert docs.columns == before.columns
    got = docs.collect()
    assert sorted(r["doc_id"] or -1 for r in got if r["doc_id"] != 4) == [-1, 1]
    assert all(r["piece_ids"] for r in got)


def test_columns_and_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == 0


def test_one_of_each_keeps_one_row(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "a"), (1, long, "a"), (5, long, "b"), (7, None, "c"), (8, "", "d"), (9, "other words stand here now", "e"), (None, "alone with no id at all", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string").withColumns({n: F.col("_gone") for n in ("_bucket", "_n", "_id", "_BUCKET_")})
    got = ngram_join.one_of_each(df, ngram_join.Rule()).collect()
    assert sorted(((r["doc_id"] or -1), r["_gone"]) for r in got) == [(-1, "f"), (1, "a"), (7, "c"), (8, "d"), (9, "e")]
    assert all(r["_gone"] == r["_bucket"] == r["_n"] == r["_id"] == r["_BUCKET_"] for r in got)


def test_each_text_of_a_shared_id_is_judged_for_itself(spark, monkeypatch):
    long, other = ("one two three four five six seven eight nine ten", "a b c d e f g h i j k l")
    rows = [(1, long), (5, long), (5, other), (5, other), (5, None), (6, "z y x w v u t"), (6, "q w e r t y u i o p"), (7, other + " m"), (None, long)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    want = sorted([(1, long), (5, other), (5, ""), (6, rows[5][1]), (6, rows[6][1]), (-1, long)])
    for buckets in (ngram_join.ID_BUCKETS, 1):  # one bucket: all rows are doubtful
        monkeypatch.setattr(ngram_join, "ID_BUCKETS", buckets)
        got = ngram_join.one_of_each(df, ngram_join.Rule()).collect()
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == want


def test_columns_named_like_results_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"kept": F.lit("k"), "n_hit": F.lit("h"), "n_words": F.col("doc_id"), "secret_base": F.lit("s"), "component_id": F.lit(1), "_keys": F.lit(2), "_chars": F.lit(3), "_gone": F.lit(4), "_bucket": F.lit(5), "_n_words_before": F.lit(6)})
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        rows = docs.select("doc_id", "kept", "n_hit", "n_words", "component_id", "_keys", "_chars", "_gone", "_bucket", "_n_words_before").collect()
        assert rows and all(tuple(r) == (r["doc_id"], "k", "h", r["doc_id"], 1, 2, 3, 4, 5, 6) for r in rows)
    assert docs.filter("secret_base = 's'").count() == len(rows)
