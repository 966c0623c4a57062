"""Stems against samples recalled from those published, cover density against its definition, search in one and in many passes, nearest vectors."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import stemming
from lectern.functions.stemming import index_words, romanian, russian
from lectern.operators import corpus, inverted, ranking, trigrams
from lectern.queries import retrieval

# Word and stem, recalled from the samples published with the rules; the vocabularies themselves are not at hand.
RUSSIAN = """вавиловка вавиловк|вагнера вагнер|вагон вагон|вагона вагон|вагоне вагон|вагонов вагон|вагоном вагон|вагоны вагон|важная важн|важнее важн|важнейшие важн|важнейшими важн|важничал важнича|важно важн|важного важн|важной важн|важном важн|важному важн|важности важност|важностию важност|важность важност|важностью важност|важную важн|важны важн|важные важн|важный важн|важным важн|важных важн|вазах ваз|вазы ваз|вакса вакс|вакханка вакханк|вал вал|валандался валанда|валентина валентин|валериановых валерианов|валерию валер|валетами валет|п п|па па|пава пав|павел павел|павильон павильон|павильонам павильон|павла павл|павлиний павлин|павлиньи павлин|павлиньим павлин|павлович павлович|павловна павловн|павловне павловн|павловной павловн|павловну павловн|павловны павловн|павловцы павловц|павлу павл|павлыч павлыч|павлыча павлыч|пагубная пагубн|падает пада|падай пада|падал пада|падала пада|падаль падал|падать пада|падаю пада|падают пада|падающего пада|падающие пада|падеж падеж|падение паден|падением паден|падении паден|падений паден|падения паден|паденье паден|паденья паден|падет падет|падут падут|падучая падуч|падчерицей падчериц|падчерицы падчериц|падшая падш|падшей падш|падшему падш|падший падш|падшим падш|падших падш|падшую падш|паек паек|пазуха пазух|пазуху пазух|пай па|пакет пакет|пакетом пакет|пакеты пакет|пакостей пакост|пакостит пакост|пакостно пакостн|пал пал"""
ROMANIAN = """abruptă abrupt|absent absent|absentă absent|absente absent|absența absenț|absență absenț|absenți absenț|absolut absol|absoluta absol|absolută absol|absolute absol|absolutul absol|absolutului absol|absoluți absoluț|absolve absolv|absolvenți absolvenț|absolvenții absolvenț|absolvi absolv|absolvire absolv|absolvit absolv|absolvită absolv|absolviți absolv|absorbant absorb|absorbantă absorb|absorbi absorb|absorbit absorb|absorbite absorb|absorbiți absorb|absorbția absorbț|abstinent abstinent|abstract abstract|abstractă abstract|abstracte abstract|abstractiza abstractiz|abstractizare abstractiz|abstractizat abstractiz|abstractizăm abstractiz|abstracție abstracț|abstracții abstracț|ocol ocol|ocolea ocol|ocolesc ocol|ocolește ocol|ocoli ocol|ocolim ocol|ocolind ocol|ocolire ocol|ocolit ocol|ocolită ocol|ocoliți ocol|ocolul ocol|ocoluri ocolur|ocolurile ocolur|ocrotit ocrot|ocrotite ocrot|ocrotirea ocrot|ocroti ocrot"""


@pytest.mark.parametrize("stem,samples", [(russian, RUSSIAN), (romanian, ROMANIAN)])
def test_published_stems(stem, samples):
    pairs = [x.split() for x in samples.split("|")]
    assert [(w, stem(w)) for w, _ in pairs] == [(w, s) for w, s in pairs]


def test_words_of_an_index():
    assert index_words("Autorizație, AUTORIZAȚIA și autorizației!", "ro") == ["autorizat", "autorizat", "si", "autoriz"]
    assert index_words("Он и Ёлка в важных 12_a", "ru") == ["", "", "елк", "", "важн", "12_a"]
    assert index_words("Straße cœur à Ελλάδα", None) == ["stras", "coeur", "a", "ελλαδα"]
    assert index_words("", None) == []


def slow_covers(found: list[tuple[int, int]]) -> int:
    """From each place on: the first end, and from there back the last beginning."""
    n, at = 0, 0
    while True:
        ends = [e for e, b in found if b >= at]
        if not ends:
            return n
        e = min(ends)
        at = max(b for x, b in found if x == e and b >= at) + 1
        n += 1


def test_covers():
    r = random.Random(4)
    for _ in range(500):
        found = [(b + r.randint(0, 3), b) for b in (r.randint(0, 12) for _ in range(r.randint(0, 9)))]
        assert corpus.covers(found) == slow_covers(found)


TEXTS = [(1, "Autorizație de construire; cod fiscal vechi", "ro"), (2, "coduri fiscale, codul fiscal și autorizația", "ro"), (3, "важные документы и важный", "ru"), (4, "nimic", None), (5, None, "ro"), (6, "fiscal cod", "ro")]
ASKED = [(1, "autorizație construire"), (2, "cod-fiscal fiscal"), (3, "важных"), (4, "de la"), (5, None)]


@pytest.mark.parametrize("most_terms", [1000, 2])
def test_matched(spark, most_terms):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    asked = spark.createDataFrame(ASKED, "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]): (r["terms"], round(r["score"], 6)) for r in corpus.matched(docs, asked, "doc_id", language=F.col("lang"), most_terms=most_terms).collect()}
    assert got[1, 1] == (2, 0.2) and got[1, 2] == (1, 0.1) and got[3, 3] == (1, 0.2)
    # a phrase that holds a found word adds no cover of its own
    assert got[2, 2] == (2, 0.2) and got[2, 6] == (1, 0.1) and got[2, 1] == (2, 0.1)
    assert {q for q, _ in got} == {1, 2, 3, 4} and got[4, 1] == (1, 0.1)
    of_texts, of_lines = corpus.matched_lines(docs.selectExpr("doc_id % 2 as chunk_id", "doc_id as line_id", "text as line", "lang"), asked, language=F.col("lang"), most_terms=most_terms)
    assert {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in of_texts.collect()}[2, 0] == 0.3
    assert of_lines.count() == len(got)
    assert corpus.matched(docs.limit(0), asked, "doc_id").count() == 0 == corpus.matched(docs, asked.limit(0), "doc_id").count()


@pytest.mark.parametrize("most", [10**6, 16])
@pytest.mark.parametrize("name", ["long", "string"])
def test_nearest_with_ties(spark, most, name):
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=(300, 8)), 1)
    v[50:250] = v[50]  # one vector with many copies
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").withColumn("vec_id", F.col("vec_id").cast(name)).repartition(7)
    probes = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in (0, 50, 299)], "probe long, embedding array<double>")
    got = {(x["probe"], x["rank"]): x["vec_id"] for x in ranking.batch_topk(probes, df, 5, most_probes=most).collect()}
    cast = int if name == "long" else str
    for p in (0, 50, 299):
        order = sorted(range(300), key=lambda i: (-round(float(v[i] @ v[p]), 12), cast(i)))
        assert [got[p, k + 1] for k in range(5)] == [cast(i) for i in order[:5]]
    plan = ranking.batch_topk(probes, df, 5)._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.rpartition("MapInArrow")
    assert before and after.count("Exchange") <= 1  # that of the test's own repartition
    assert ranking.batch_topk(probes.limit(0), df, 5).count() == 0 == ranking.batch_topk(probes, df.limit(0), 5).count()


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(9)
    rows = [(d, i, "".join(r.choice(["Ab", "bA", "é", "%", "_", "ca", " ", "ABC"]) for _ in range(r.randint(0, 12)))) for d in range(60) for i in range(r.randint(1, 6))]
    lines = spark.createDataFrame(rows, "doc_id long, idx int, line string")
    trigrams.build(lines, f"file://{tmp_path}/index")
    texts = ["", "a", "%_", "abc", "ABCab", "éab", "ab%ca_", "nowhere", "abababababab", None, "caca ca", "c"]
    asked = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    want = {(k, d, i) for k, t in enumerate(texts) if t for d, i, line in rows if t.lower() in line.lower()}
    got = trigrams.search(spark, f"file://{tmp_path}/index", asked)
    assert {(x["text_id"], x["doc_id"], x["idx"]) for x in got.collect()} == want and len(want) > 50
    first = trigrams.search(spark, f"file://{tmp_path}/index", asked, 2).collect()
    assert {(x["text_id"], x["doc_id"], x["idx"]) for x in first} == {x for k in range(len(texts)) for x in sorted(w for w in want if w[0] == k)[:2]}
    one = trigrams.search(spark, f"file://{tmp_path}/index", asked.filter("text_id = 6"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


@pytest.mark.parametrize("lists", [1, 4])
def test_inverted_lists(spark, sf, tmp_path, lists):
    v = spark.read.parquet(f"{sf}/../sf0.01/embeddings.parquet").select("vec_id", "embedding")
    v = v.unionByName(v.filter("vec_id < 30").withColumn("vec_id", F.col("vec_id") + 10**6)).unionByName(spark.createDataFrame([(-1, None)], v.schema))
    index = inverted.build(v, f"file://{tmp_path}/lists", 16)
    probes = v.filter("vec_id % 20 = 0").selectExpr("vec_id as probe", "embedding")
    want = {(r["probe"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in ranking.batch_topk(probes, v, 5).collect()}
    exact = {(r["probe"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in inverted.topk(index, probes, 5, lists, exact=True).collect()}
    assert exact == want
    near = {(r["probe"], r["vec_id"]) for r in inverted.topk(index, probes, 5, 3 * lists).collect()}
    recall = len(near & {(p, x) for (p, _), (x, _) in want.items()}) / len(want)
    print(f"recall with {3 * lists} of 16 lists: {recall:.3f}")
    assert recall >= (0.9 if lists == 4 else 0.4)
    assert inverted.topk(index, probes.limit(0), 5, 2).count() == 0
    empty = inverted.build(v.limit(0), f"file://{tmp_path}/none", 4)
    assert inverted.topk(empty, probes, 5, 2).count() == 0


def test_postings_are_lists_of_pieces(spark, tmp_path):
    r = random.Random(4)
    rows = [(d, 0, "".join(r.choice("abcdé😀 ") for _ in range(r.randint(0, 40)))) for d in range(1200)] + [(2000, 0, "xyz" * 50)]
    trigrams.build(spark.createDataFrame(rows, "doc_id long, idx int, line string").coalesce(1), f"file://{tmp_path}/index")
    postings = spark.read.parquet(f"file://{tmp_path}/index/postings")
    assert postings.count() == len({line[i : i + 3] for _, _, line in rows for i in range(len(line) - 2)})  # one of each gram and document before


def test_grams_of_pieces_by_slices(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abcé😀") for _ in range(r.choice([0, 2, 3, 9]))) for _ in range(300)]
    blocks, pieces = [i // 64 for i in range(300)], [i % 64 // 4 for i in range(300)]
    batch = trigrams.pa.RecordBatch.from_pydict({"block": trigrams.pa.array(blocks, "int64"), "piece": trigrams.pa.array(pieces, "int32"), "text": texts})
    code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    want = {(code(t[i : i + 3]), b, p) for t, b, p in zip(texts, blocks, pieces, strict=True) for i in range(len(t) - 2)}
    for chars, lines in [(1 << 21, 1 << 12), (1, 1 << 12), (50, 7)]:
        monkeypatch.setattr(trigrams, "SLICE_CHARS", chars)
        monkeypatch.setattr(trigrams, "SLICE_LINES", lines)
        found = [x for part in trigrams._postings(iter([batch])) for x in part.to_pylist()]
        assert {(x["gram"], x["block"], p) for x in found for p in x["pieces"]} == want and all(x["n"] == len(x["pieces"]) for x in found)


def test_words_of_an_index_are_plain(spark, tmp_path):
    df = spark.createDataFrame([(1, "x² ΟΔΟΣ Ångström", "en"), (2, "Straße _a x²", "de"), (3, None, None), (4, "", "ru")], "doc_id long, text string, lang string")
    found = sorted(r["word"] for r in corpus.vocabulary(df).collect())
    assert found == sorted(["x²", "οδοσ", "angstrom", "strasse", "_a"])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan = retrieval.russian_stems(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # a filter on the stem took all stems twice


def test_combined_suffixes_of_nine_letters():
    assert [romanian(w) for w in ("abaoăivităiabilitati", "adiieaabilitate", "amabilitate", "sensibilitate")] == ["abaoăivităi", "adiie", "amabil", "sensibil"]


def test_letters_are_made_plain_in_one_step():
    for text in ("ǿ ø Ø é", "Știință, Straße; Ἀθῆναι ё", "á ǽ æ"):
        assert stemming._plain(text) == text.translate(stemming._PLAIN)
    stemming._stem.cache_clear()
    for again in range(2):  # as many words as the texts of sf0.1 have in each quarter; a smaller cache forgot all of them
        for n in range(80_000):
            stemming._stem(f"w{n}", False)
    assert stemming._stem.cache_info().misses == 80_000
    stemming._stem.cache_clear()
