"""Inputs on which a cut of the work would show."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import acts, texts
from lectern.operators import analytics, answers, documents, ranking, titles
from lectern.queries import retrieval


def near_rows(n_other: int) -> list[tuple[int, list[float], int]]:
    at = lambda c: [float(c), float(np.sqrt(1 - c * c))]
    others = [(20 * i + 1, at(0.9 - i * 1e-5), 1) for i in range(n_other)]
    return [(0, [1.0, 0.0], 0), *others, (5, at(0.88), 0), (6, at(0.86), 0), (7, at(0.27), 0), (8, at(0.5), None), (20, [0.0, 1.0], None)]


def test_a_bonus_counts_for_every_row(spark, tmp_path):
    rows = near_rows(200)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["probe"], r["position"]): r["vec_id"] for r in retrieval.nearest_with_boost(spark, str(tmp_path)).collect()}
    assert (got[0, 1], got[0, 2]) == (5, 6)  # more than 60 rows of another label lie closer
    assert got[20, 1] == 7  # a null label has no bonus


@pytest.mark.parametrize("most_probes", [64, 1 << 20])
def test_boosted_topk_is_exact(spark, most_probes):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 4)).round(1)
    label = rng.integers(0, 3, 120).tolist()
    df = spark.createDataFrame([(i, v[i].tolist(), label[i]) for i in range(120)], "vec_id long, embedding array<double>, label int")
    probes = df.filter("vec_id < 9").withColumnRenamed("vec_id", "probe")
    got = {(r["probe"], r["rank"]): r["vec_id"] for r in ranking.boosted_topk(probes, df, 3, "label", 0.5, 0.3, most_probes=most_probes).collect()}
    for p in range(9):
        scores = sorted((-(round(float(v[p] @ v[i]), 9) + 0.5 * (label[i] == label[p])), i) for i in range(120))
        assert [got.get((p, k + 1)) for k in range(3)] == [i if -s >= 0.3 else None for s, i in scores[:3]]


def test_large_groups_are_not_packed_into_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").alias("g"), "id", (F.col("id") * 7919 % 1000).cast("double").alias("v"), F.lit(1).alias("size"), F.lit("ok").alias("status"))
    ranks = analytics.nearest_rank(df, "g", "v", {"p50": 0.5, "p95": 0.95})
    gaps = analytics.gap_items(df, "g", ["id"], "status", F.array(F.col("v").cast("int")), F.array("status"), 3)
    budget = answers.greedy_budget(df, "g", "id", "id", "size", 2)
    values = {g: sorted(r["v"] for r in df.collect() if r["g"] == g) for g in ("hot", None)}
    assert {r["g"]: (r["p50"], r["p95"]) for r in ranks.collect()} == {g: tuple(v[round(p * (len(v) - 1))] for p in (0.5, 0.95)) for g, v in values.items()}
    assert {r["g"]: (r["n"], r["missing"], r["sites"]) for r in gaps.collect()} == {"hot": (2000, [0, 919, 757], ["ok"]), None: (1000, [838, 595, 352], ["ok"])}
    assert sorted((r["g"] or "", r["source_no"], r["id"]) for r in budget.collect()) == [("", 1, 2), ("", 2, 5), ("hot", 1, 0), ("hot", 2, 1)]
    for plan in (ranks, budget):
        assert "collect_list" not in plan._jdf.queryExecution().toString()


def test_decisions_in_batches_name_groups(spark):
    rows = [(1, 1, 10, "N1", None), (1, 2, 11, "G1", 5), (1, 3, 12, "N1", None), (2, 1, 13, "N1", None), (2, 2, 10, "G1", 11), (2, 3, None, "N2", None)]
    got = {r["head"]: r["group"] for r in analytics.sorted_heads(spark.createDataFrame(rows, "batch int, n int, head int, label string, known int")).collect()}
    assert got == {10: 11, 11: 5, 12: 10, 13: 13, None: None}  # a head that is sorted again is where the last batch put it
    asked = spark.createDataFrame([(1, 10, 1, "partial", False, None), (2, 12, 2, "not_found", None, "partial"), (3, 99, 3, "partial", True, None), (4, 13, 4, "partial", False, "answered"), (5, 98, 5, "partial", False, None)], "answer_id int, head int, created_at int, status string, hidden boolean, rechecked string")
    decided = spark.createDataFrame([(10, 10), (12, 10)], "head int, group int")
    listed = lambda **more: [(r["group"], r["count"], r["last_asked"]) for r in analytics.gap_list(asked, decided, **more).collect()]
    assert listed() == [(10, 2, 2), (98, 1, 5)] and listed(order="recent") == [(98, 1, 5), (10, 2, 2)] and listed(most=1) == [(10, 2, 2)]
    assert listed(hidden=True) == [(10, 2, 2), (98, 1, 5), (99, 1, 3)] and listed(order="not_found") == [(10, 2, 2), (98, 1, 5)]


def test_scores_are_held_a_tile_at_a_time():
    rng = np.random.default_rng(5)
    asked, v = rng.normal(size=(4000, 8)).round(1), np.repeat(rng.normal(size=(1000, 8)).round(1), 2, axis=0)  # each vector twice
    labels = rng.integers(0, 3, 4000), rng.integers(0, 3, 2000)
    tracemalloc.start()
    best = ranking._Best(len(asked), 3, 9)
    for at in range(0, 2000, 500):
        best.scan(np.arange(at, at + 500), v[at : at + 500], asked, labels=(labels[0], labels[1][at : at + 500]), bonus=0.5)
    got = [tuple(x.tolist() for x in part) for part in best.rows()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # 8,000,000 scores are 64 MB, and what is compared of them several times that
    found = [(p, k) for part in got for p, k in zip(*part[:2], strict=True)]
    value = np.round(asked @ v.T, 9) + 0.5 * (labels[0][:, None] == labels[1][None, :])
    assert found == [(p, int(k)) for p in range(4000) for k in np.lexsort((np.arange(2000), -value[p]))[:3]]


def test_some_probes_and_scores_that_are_no_numbers():
    best = ranking._Best(3, 2, 12)
    best.scan(np.array([7, 8, 9]), np.array([[np.nan], [1.0], [2.0]]), np.array([[1.0], [1.0], [-1.0]]), np.array([0, 2]))
    best.scan(np.array([1]), np.array([[2.0]]), np.array([[1.0], [1.0], [-1.0]]), np.array([0]))
    assert [tuple(x.tolist() for x in part[:3]) for part in best.rows()] == [([0, 0, 2, 2], [1, 9, 8, 9], [2.0, 2.0, -1.0, -2.0])]


def test_texts_of_a_batch_are_a_few_objects_at_a_time(spark):
    most = []
    kept = texts._pieces(300, pa.list_(pa.string()), lambda at, n: most.append(n) or [None if i % 7 == 0 else [str(i)] for i in range(at, min(at + n, 300))])
    assert max(most) <= 128 and kept.to_pylist() == [None if i % 7 == 0 else [str(i)] for i in range(300)]
    assert texts._pieces(0, pa.string(), lambda at, n: []).to_pylist() == []
    df = spark.range(300).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("casele  ş "), "id")).alias("t"), F.when(F.col("id") % 2 > 0, "ru").alias("l"))
    got = {r["id"]: (r["n"], r["w"]) for r in df.select("id", texts.normalised(F.col("t")).alias("n"), texts.lexemes(F.col("t"), F.col("l")).alias("w")).collect()}
    assert all(got[i] == (None, None) if i % 7 == 0 else got[i][0] == f"casele ș {i}" and got[i][1][-1] == str(i) for i in range(300))


def test_documents_are_described_from_one_look_at_their_blocks(spark):
    rows = [(1, 0, "heading", "Primăria"), (1, 1, "paragraph", "DECIZIE nr. 3"), (1, 2, "paragraph", "Cu privire la apă"), (1, 3, "paragraph", "din 01.02.2006"), (2, 0, "paragraph", "ORDIN nr. 4"), (2, 1, "paragraph", "din 5 mai 2020")]
    found = titles.heads(spark.createDataFrame(rows, "doc_id int, id int, type string, text string"))
    assert {r["doc_id"]: r["own"] for r in found.collect()} == {1: "DECIZIE nr. 3", 2: "ORDIN nr. 4\ndin 5 mai 2020"}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_act_is_found_by_few_searches(spark):
    df = spark.createDataFrame([("Legea din 31.13.2019, 7_mai_2021; decizia",), ("٣.٠١.٢٠٢٠ 3.01.2020",), ("xordin 12-03-1999",), (None,)], "t string")
    found = df.select(acts.act_type(F.col("t")).alias("kind"), acts.act_date(F.col("t")).alias("date"))
    assert [tuple(r) for r in found.collect()] == [("lege", "2021-05-07"), (None, None), (None, "1999-03-12"), (None, None)]
    plan = df.select(acts.act_type(F.col("t")).alias("kind"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr") + plan.count("regexp_extract") == 1  # one a type before


def test_long_tables_are_cut_in_one_look_at_each_row(spark):
    rows = [[str(i), None if i == 0 else "x", *["y"] * (i % 3 == 0)] for i in range(400)]
    df = spark.createDataFrame([(["a", "b"], rows), (["a"], [["1"], ["2", None, "3"]]), (["a"], []), ([], []), (["a"], None)], "h array<string>, r array<array<string>>")
    kept, small, bare, none, null = (r["t"] for r in df.select(documents.table_chunks(F.col("h"), F.col("r"), 300, 600).alias("t")).collect())
    assert small == ["| a |  |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | 3 |"] and bare == ["| a |\n| --- |"] and none == [""] and null is None
    line = lambda r, n: "| " + " | ".join(c for c in [*r, *[""] * (n - len(r))] if c is not None) + " |"
    text = lambda rs: "\n".join([line(["a", "b"], n := max(2, *map(len, rs))), line(["---"] * n, n), *(line(r, n) for r in rs)]) if rs else ""
    want, group = [], []
    for r in rows:  # a cell that is null stopped the cuts before
        group.append(r)
        if len(text(group)) >= 300:
            want, group = [*want, text(group)], []
    assert kept == (want + [text(group)] if group else want)
    plan = df.select(texts.markdown_table(F.col("h"), F.col("r")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_max") == 1  # the widest row was looked for in every row
