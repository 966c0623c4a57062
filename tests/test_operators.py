"""Operators against literal cases and invariants."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import analytics, answers, corpus, documents, ranking, records, web
from lectern.plans.retrieve import retrieve
from lectern.session import shared_dir
from lectern.sources import readers
from lectern.sources.snapshots import SnapshotTable, exported, imported
from lectern.streaming import usage


def test_split_long_covers_the_text():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abc.") for _ in range(r.randint(1, 30))) for _ in range(900)) + "".join(map(str, range(700)))
    parts = documents.split_long(text)
    assert all(len(p) <= 2500 for p in parts) and len(parts) > 3
    at = 0
    for p in parts:  # each part begins inside or right after the one before
        place = text.find(p, max(0, at - 1600))
        assert 0 <= place <= at + 1
        at = place + len(p)
    assert at >= len(text) - 1
    assert documents.split_long("short") == ["short"]


BLOCKS = "doc_id long, id int, type string, level int, text string, lang string"


def chunks(spark, rows):
    df = spark.createDataFrame(rows, BLOCKS)
    return documents.chunked(documents.with_legal_paths(documents.with_sections(df))).orderBy("doc_id", "ord").collect()


def test_headings_attach_to_what_follows(spark):
    p = "Un paragraf destul de lung ca să nu fie aruncat, despre taxe locale. " * 3
    got = chunks(spark, [(1, 0, "heading", 1, "Titlu", "ro"), (1, 1, "heading", 2, "Parte", "ro"), (1, 2, "paragraph", None, p, "ro"), (1, 3, "heading", 2, "Alta", "ro"), (1, 4, "paragraph", None, p, "ro"), (1, 5, "paragraph", None, p.replace("taxe", "налоги"), "ru")])
    assert [list(c["section"]) for c in got] == [["Titlu", "Parte"], ["Titlu", "Alta"], ["Titlu", "Alta"]]
    assert got[0]["text"].startswith("Titlu\n\nParte\n\nUn")
    assert len({c["chunk_id"] for c in got}) == 3


def test_short_legal_items_become_a_range(spark):
    rows = [(1, 0, "heading", 1, "Capitolul I", "ro")] + [(1, i, "paragraph", None, f"{i}. Punct scurt despre ceva anume.", "ro") for i in range(1, 5)]
    got = chunks(spark, rows)
    assert got[-1]["legal_path"][-1] == "pct. 1–4" or got[-1]["legal_path"][-1].endswith("–4")
    assert all(f"{i}. Punct" in " ".join(c["text"] for c in got) for i in range(1, 5))


def test_tails_and_tables(spark):
    got = chunks(spark, [(1, 0, "paragraph", None, "scurt", "ro"), (2, 0, "table", None, "| a |", "ro"), (3, 0, "paragraph", None, "   ", "ro")])
    assert [(c["doc_id"], c["is_table"]) for c in got] == [(2, True)]


def test_fine_lines(spark):
    long = "Propoziție întâi. " * 40
    df = spark.createDataFrame([(1, "scurt\nlinie mai lungă de douăzeci\nx"), (2, long), (3, "w" * 30 + " " + "y " * 300), (4, ""), (5, None), (6, "a")], "chunk_id long, text string")
    got = {}
    for r in documents.fine_lines(df).orderBy("chunk_id", "idx").collect():
        got.setdefault(r["chunk_id"], []).append(r["line"])
    assert got[1] == ["scurt linie mai lungă de douăzeci x"] and got[6] == ["a"] and 4 not in got and 5 not in got
    assert all(25 <= len(x) <= 400 for x in got[2]) and " ".join(got[3]) == ("w" * 30 + " " + "y " * 300).strip()


def test_stack_paths(spark):
    rows = [(1, 0, 1, "a"), (1, 1, 3, "b"), (1, 2, 2, "c"), (1, 3, None, "-"), (1, 4, 3, "d"), (1, 5, 1, "e")]
    df = spark.createDataFrame(rows, "doc_id long, id int, lv int, t string")
    out = df.select("id", documents.stacked(df, "doc_id", "id", F.col("lv"), F.col("t"), 5, F.lit(None).cast("int")).alias("p")).orderBy("id").collect()
    assert [list(r["p"]) for r in out] == [["a"], ["a", "b"], ["a", "c"], ["a", "c"], ["a", "c", "d"], ["e"]]


def test_retrieve_in_five_chunks(spark):
    ranks = lambda items: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(items)], "query_id long, chunk_id string, rank int")
    lines = spark.createDataFrame([(1, "l1", "c", 0.9, 1), (1, "l2", "a", 0.8, 2), (1, "l3", "c", 0.7, 3)], "query_id long, line_id string, chunk_id string, score double, rank int")
    text_lines = spark.createDataFrame([(1, "l1", "c", 5.0, 1), (1, "l9", "a", 0.85, 2)], "query_id long, line_id string, chunk_id string, score double, rank int")
    chunk_rows = [(c, "file" if c in "ab" else "page", "decizie" if c == "b" else None, f"https://e.md/{c}" + (".pdf" if c in "ab" else ".html"), f"text of {c} with words", "same" if c in "bd" else c, 2) for c in "abcde"]
    ch = spark.createDataFrame(chunk_rows, "chunk_id string, kind string, doc_type string, url string, text string, content_hash string, page int")
    all_lines = spark.createDataFrame([(f"{c}{i}", c, i, "x") for c in "abcde" for i in range(5)], "line_id string, chunk_id string, idx int, line string")
    got = retrieve(ranks("abd"), lines, ranks("dce"), text_lines, ch, all_lines).orderBy("position").collect()
    score = {r["chunk_id"]: r["score"] for r in got}
    assert [r["chunk_id"] for r in got] == ["a", "c", "b", "e"]  # d is a copy of b, which is the official act
    assert score["a"] == pytest.approx(1 / 61 + 1 / 62) and score["c"] == pytest.approx(1 / 61 + 0.1 / 62)
    assert score["b"] == pytest.approx(max(1 / 62, 1 / 63 + 0.1 / 61))
    by = {r["chunk_id"]: r for r in got}
    assert [m["line_id"] for m in by["c"]["matched"]] == ["l1", "l3"] and [m["line_id"] for m in by["a"]["matched"]] == ["l9", "l2"]
    assert [m["line_id"] for m in by["e"]["matched"]] == ["e0", "e1", "e2"]
    assert by["a"]["link"] == "https://e.md/a.pdf#page=2" and by["c"]["link"].startswith("https://e.md/c.html#:~:text=text%20of%20c")
    shuffled = retrieve(ranks("abd").repartition(7), lines.repartition(3), ranks("dce"), text_lines, ch.repartition(5), all_lines).orderBy("position").collect()
    assert shuffled == got


def test_leaders_are_greedy(spark):
    rows = [(0, "g", [1.0, 0.0]), (1, "g", [0.9, 0.43589]), (2, "g", [0.6, 0.8]), (3, "g", [0.0, 1.0]), (4, "h", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, grp string, v array<double>")
    got = {r["k"]: r["leader"] for r in analytics.leaders(df, "grp", ["k"], "k", "v", 0.85).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_leaders_of_large_groups_settle_in_rounds(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(int(i), "a" if i % 3 else "b", int(rng.integers(0, 5)), v[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, grp string, o int, v array<double>").repartition(3)
    want = {}
    heads: dict = {"a": [], "b": []}
    for k, g, _, x in sorted(rows, key=lambda r: (r[2], r[0])):
        want[k] = next((h for h, y in heads[g] if np.dot(x, y) >= 0.8), k)
        if want[k] == k:
            heads[g].append((k, x))
    assert {r["k"]: r["leader"] for r in analytics.leaders(df, "grp", ["o"], "k", "v", 0.8, block=block).collect()} == want


def test_rejected_hits_do_not_count(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 1, 2, 3, 59, 60, 61, 62])]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(r["event_id"] for r in analytics.accepted(df, "user_id", "ts", "event_id", 2, 60).collect())
    assert got == [0, 1, 5, 6]


def test_stream_and_batch_agree(spark, sf):
    stream = usage.drained(usage.accepted(usage.source(spark, sf, "events"), 2, 86400), "update")
    batch = analytics.accepted(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "event_id", 2, 86400)
    assert sorted(map(tuple, stream.select("user_id", "event_id").collect())) == sorted(map(tuple, batch.select("user_id", "event_id").collect()))


def test_misses_remove_at_the_second(spark):
    docs = spark.createDataFrame([("a", 0, "downloaded"), ("b", 1, "downloaded"), ("c", 1, "downloaded"), ("d", 3, "removed")], "key string, missing int, status string")
    seen = spark.createDataFrame([("c",), ("d",), ("c",)], "key string")
    got = {r["key"]: (r["missing"], r["status"]) for r in records.crawl_misses(docs, seen).collect()}
    assert got == {"a": (1, "downloaded"), "b": (2, "removed"), "c": (0, "downloaded"), "d": (0, "removed")}


def test_signals_keep_six_hours(spark):
    f = lambda nxt, last: spark.createDataFrame([(nxt, last)], "n string, l string").select(records.next_check(F.col("n").cast("timestamp"), F.col("l").cast("timestamp"), F.lit("2024-01-01 12:00:00").cast("timestamp")).cast("string")).first()[0]
    assert f(None, None) == "2024-01-01 12:00:00" and f("2024-01-02 00:00:00", "2024-01-01 10:00:00") == "2024-01-01 16:00:00" and f("2024-01-01 11:00:00", None) == "2024-01-01 11:00:00"


def test_snapshots(spark):
    t = SnapshotTable(spark, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    assert t.read() is None
    t.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), "k")
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    assert [tuple(r) for r in exported({"t": t.read()}, path).collect()] == [("t", 3)]
    fresh = SnapshotTable(spark, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    assert imported(spark, path, ["t"], {"t": fresh}) and not imported(spark, path, ["t"], {"t": fresh}) and fresh.read().count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text('{"doc_id": "d1", "sha256": "s",\n "blocks": [{"id": 0, "type": "heading", "level": 2, "text": "T"}, {"id": 1, "type": "list_item", "text": "x"}]}')
    docs = readers.parsed_documents(spark, f"file://{tmp_path}/d")
    assert readers.markdown(docs).first()["markdown"] == "## T\n\n- x"
    registry = spark.createDataFrame([("s", "downloaded", "parsed"), ("z", "removed", "parsed")], "sha256 string, status string, parse_status string")
    assert readers.active_documents(docs, registry).count() == 1
    log = spark.createDataFrame([("q", "2024-01-01 10:00:00"), ("r", "2024-01-02 10:00:00")], "q string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    readers.append_log(log, f"file://{tmp_path}/log")
    assert readers.read_log(spark, f"file://{tmp_path}/log", "q string, ts timestamp").filter("day = '2024-01-02'").first()["q"] == "r"
    xml = "<urlset><url><loc>https://e.md/?a=1&amp;b=2</loc><lastmod>2024-05-01</lastmod></url><url><loc> https://e.md/b </loc></url></urlset>"
    rows = readers.sitemap(spark.createDataFrame([(xml,)], "xml string"), since="2024-06-01").collect()
    assert [(r["kind"], r["loc"]) for r in rows] == [("url", "https://e.md/b")]
    sites = readers.site_settings(spark, '[defaults]\nmax_pages = 7\n[[sites]]\nid = "a"\nurl = "https://a"\n[[sites]]\nid = "b"\nurl = "https://b"\nmax_pages = 9')
    assert [r["max_pages"] for r in sites.orderBy("id").collect()] == [7, 9]
    chars = spark.createDataFrame([({1: 500, 2: 50},), ({},), ({1: 100},)], "c map<int,int>")
    assert [r[0] for r in chars.select(readers.needs_ocr(F.col("c"))).collect()] == [True, True, False]


def test_pages(spark):
    html = "<head><title>x</title></head><body><nav>menu</nav><h1>A &amp; B</h1><p>one<p>two <b>bold</b><ul><li>i1<li>i2</ul><script>no()</script></body>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r["type"], r["level"], r["text"]) for r in web.blocks(df).orderBy("id").collect()]
    assert got == [("heading", 1, "A & B"), ("paragraph", None, "one"), ("paragraph", None, "two bold"), ("list_item", None, "i1"), ("list_item", None, "i2")]
    rows = spark.createDataFrame([("s", p, t) for p in range(5) for t in ("Same ", f"own {p}")] + [("s", 0, "call 022 201 500")] * 2 + [("small", 9, "Same")], "site string, page_id int, text string")
    dropped = {(r["site"], r["key"]) for r in web.repeated_blocks(rows).filter("dropped").collect()}
    assert dropped == {("s", "same")}
    assert web.without_repeated(rows, web.repeated_blocks(rows)).filter("site = 's' and text = 'Same '").count() == 0
    clean = spark.createDataFrame([('<p onclick="x()">a<script>b</script><a href="javascript:c()">d</a></p>',)], "h string").select(web.sanitised(F.col("h"))).first()[0]
    assert clean == '<p>a<a href="#">d</a></p>'
    dated = spark.createDataFrame([('<meta property="article:published_time" content="2024-03-01T10:00">',), ("<time datetime='2024-04-02'>",), ("",)], "h string")
    assert [r[0] for r in dated.select(web.publication_date(F.col("h"))).collect()] == ["2024-03-01", "2024-04-02", None]


def test_prompt_has_gaps(spark):
    rows = [(1, 1, 1, "Alpha"), (1, 1, 2, "---"), (1, 1, 3, "Beta"), (1, 2, 1, " alpha "), (1, 2, 2, "Gamma")]
    shown = answers.shown_lines(spark.createDataFrame(rows, "q int, s int, n int, t string"), "q", "s", "n", "t")
    got = {r["s"]: r["prompt"] for r in answers.rendered(shown, "q", "s", "n", "t").collect()}
    assert got == {1: "S1.L1: Alpha\n…\nS1.L3: Beta", 2: "S2.L2: Gamma"}


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([900, 200, 50, 60])] + [(2, 0, 5000)], "q int, o int, n long")
    got = [(r["q"], r["o"]) for r in answers.greedy_budget(df, "q", "o", "o", "n", 1000).orderBy("q", "source_no").collect()]
    assert got == [(1, 0), (1, 2), (2, 0)]


def test_order_rules(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate(["2020", None, "2019", "2024", "2023"], 1)], "q int, p int, d string")
    assert sorted(r["p"] for r in ranking.with_newest(rows, "q", "p", "d", 3).collect()) == [1, 2, 3, 4]
    fresh = spark.createDataFrame([(1, 1, "new")], "q int, p int, d string")
    assert [r["d"] for r in ranking.interleaved(rows, fresh, "q", "p", 2).orderBy("place").collect()] == ["2020", None, "new", "2019", "2024", "2023"]
    assert [r["p"] for r in rows.orderBy(*ranking.newest_first(rows, "d", "p")).collect()] == [4, 5, 1, 3, 2]
    assert [r["p"] for r in ranking.within_budget(rows, "q", "p", F.lit(2), 5).orderBy("p").collect()] == [1, 2]


def test_context_and_mentions(spark):
    lines = corpus.lines(spark.createDataFrame([(1, "a\n\nhit\nb\nc\nd\nHIT"), (2, None), (3, "none")], "doc_id long, text string"))
    got = [(r["idx"], r["gap"]) for r in corpus.with_context(lines, corpus.contains(F.col("line"), "hit"), 1).orderBy("idx").collect()]
    assert got == [(0, False), (1, False), (2, False), (4, True), (5, False)]
    assert [tuple(r) for r in corpus.mentions(lines, ["hit"]).collect()] == [(1, 1, "hit")]


def test_contact_cards(spark):
    from lectern.operators import contacts

    lines = [
        (1, 0, "Direcția Generală Arhitectură, Urbanism și Relații Funciare se ocupă de certificate."),
        (1, 1, "Telefon: (022) 20-46-90, fax 0 22 20 17 07, anul 2013 - 2027"),
        (1, 2, "Adresa: str. Columna 106, MD-2012. Program: luni-vineri 8.00-17.00."),
        (2, 0, "e-mail: WWW.info@primaria.md"),
        (3, 0, "fără contacte"),
        (4, 0, "Scrieți la info@primaria.md"),
    ]
    df = spark.createDataFrame([(c, i, f"{c}:{i}", t) for c, i, t in lines], "chunk_id long, idx int, line_id string, line string")
    chunks = spark.createDataFrame([(1, "a.md", "https://a.md/x", "T"), (2, "a.md", "https://a.md/long/page", ""), (3, "a.md", "https://a.md", ""), (4, "a.md", "https://a.md/contacte/longer/still", "")], "chunk_id long, site string, url string, title string")
    got = contacts.cards(chunks, df).collect()
    card = next(r for r in got if r["phone"])
    assert card["name"] == "Direcția Generală Arhitectură, Urbanism și Relații Funciare"
    assert card["phone"] == ["(022) 20-46-90", "0 22 20 17 07"] and card["hours"].startswith("Program") and "Columna" in card["address"]
    assert card["line_ids"] == ["1:1", "1:2"] and len(got) == 3
    once = contacts.deduplicated(contacts.cards(chunks, df)).filter("size(email) > 0").collect()
    assert [(r["url"], r["email"]) for r in once] == [("https://a.md/contacte/longer/still", ["info@primaria.md"])]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_json_events_do_not_depend_on_cuts(size):
    import json

    from lectern.streaming.json_events import Reader

    value = {"a": [1, -2.5, True, None, "x"], "s": 'q"\\ é 😀 \n', "e": {}, "sentences": [{"text": "One.", "refs": ["S1.L1"]}, {"text": "Two"}]}
    text = json.dumps(value)
    events, state = [], ""
    for i in range(0, len(text), size):
        reader = Reader(state)
        events += reader.feed(text[i : i + size])
        state = reader.state()
    values = [(p, v) for k, p, v in events if k == "value"]
    assert values == [("a/0", "1"), ("a/1", "-2.5"), ("a/2", "true"), ("a/3", "null"), ("a/4", "x"), ("s", value["s"]), ("sentences/0/text", "One."), ("sentences/0/refs/0", "S1.L1"), ("sentences/1/text", "Two")]
    for path, v in values:
        shown = "".join(x for k, p, x in events if k == "text" and p == path)
        assert shown in ("", v) and (shown == v or not isinstance(v, str) or path.startswith("a/"))
    assert [p for k, p, _ in events if k == "end"] == ["a", "e", "sentences/0/refs", "sentences/0", "sentences/1", "sentences", ""]


def test_live_sentences(spark):
    import json

    from lectern.streaming import json_events

    text = json.dumps({"sentences": [{"text": "One."}, {"text": "Two."}]})
    pieces = [("x", i, text[i : i + 5]) for i in range(0, len(text), 5)] + [("y", 0, '{"sentences": [{"text": "Only')]
    path = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    spark.createDataFrame(pieces, "id string, seq long, piece string").repartition(3).write.parquet(path)
    stream = spark.readStream.schema("id string, seq long, piece string").parquet(path)
    found = usage.drained(json_events.events(stream), "append")
    assert {r["id"]: r["sentences"] for r in json_events.live_sentences(found).collect()} == {"x": ["One.", "Two."]}
    assert [r["value"] for r in found.filter("id = 'y'").collect()] == ["Only"]


def test_embedding_reuse(spark):
    from lectern.operators.embedding import embedded, hashing_embedder

    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return hashing_embedder(texts)

    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "k int, text string")
    cache = spark.createDataFrame([("84a516841ba77a5b4648de2cd0dfcb30ea46dbb4", [1.0])], "content_hash string, embedding array<float>")
    got = {r["k"]: r for r in embedded(rows, cache, counted).collect()}
    assert got[3]["reused"] and list(got[3]["embedding"]) == [1.0] and list(got[1]["embedding"]) == list(got[2]["embedding"])
    assert calls.value <= 3 and sum(x * x for x in got[1]["embedding"]) == pytest.approx(1, abs=1e-5)


def test_questions(spark):
    from lectern.functions import questions as q

    f = lambda text, g: spark.createDataFrame([(text,)], "x string").select(g(F.col("x"))).first()[0]
    assert f("Cine este primarul?", q.asks_for_now) and not f("Cum obțin?", q.asks_for_now)
    assert f("din cine e comisia", q.asks_for_members) and f("Bună ziua!", q.small_talk) and not f("Bună ziua, cât costă?", q.small_talk)
    assert f("decizia 4/1 și dispoziția 251-d", q.act_numbers_asked) == ["4/1", "251-d"]
    assert tuple(f("школа № 5", lambda c: q.category(F.lit("x.md"), c))) == ("education", "keywords")
    assert tuple(f("", lambda c: q.category(F.lit("apacanal.md"), c))) == ("urban_utilities", "rule")
    assert f("din 1 martie 2020 și 5.6.2019, 1 ianuarie 2999", lambda c: q.latest_date(c, F.lit("2024-01-01"))) == "2020-03-01"
    assert f("12/14", lambda c: q.act_patterns(c, F.lit("2020-07-28"))) == ["nr. 12/14", "nr.12/14", "nr 12/14", "12/14 din 28.07.2020"]


def test_fresh_acts_go_in_after_the_sixth(spark):
    from lectern.plans import gather

    row = lambda q, i, c, act=True: (q, c, f"h{c}", "2020", act, i)
    schema = "query_id long, chunk_id string, content_hash string, date string, is_act boolean, position int"
    chosen = spark.createDataFrame([row(1, i, f"c{i}") for i in range(1, 9)] + [row(2, 1, "x", False)], schema).withColumn("score", F.lit(1.0))
    fresh = {
        "later": spark.createDataFrame([row(1, 1, "c2"), row(1, 2, "n1"), row(1, 3, "n2"), row(1, 4, "n3"), row(1, 5, "n4"), row(2, 1, "y")], schema),
        "newer": spark.createDataFrame([row(1, 1, "n1"), row(1, 2, "n5")], schema),
        "fresh_terms": spark.createDataFrame([row(1, 1, "n6")], schema),
    }
    got = gather.refreshed(chosen, fresh, spark.createDataFrame([], "query_id long")).orderBy("query_id", "place").collect()
    assert [r["chunk_id"] for r in got if r["query_id"] == 1] == ["c1", "c2", "c3", "c4", "c5", "c6", "n1", "n2", "n3", "n5", "c7", "c8"]
    assert [r["chunk_id"] for r in got if r["query_id"] == 2] == ["x"]


def test_rosters_and_etas(spark):
    from lectern.functions.questions import is_roster

    f = lambda t: spark.createDataFrame([(t,)], "x string").select(is_roster(F.col("x"))).first()[0]
    assert f("| Ion | președinte |\n| Ana | secretar |\n| Dan | membru |") and f("1. Ion Rusu – președinte\n2. Ana Lupu – membru\n3. Dan Pop – membru")
    assert not f("membru\nmembru\nmembru") and not f(None)
    rows = [(1, 0.0, 0.0), (1, 10.0, 10.0), (1, 20.0, 10.0), (1, 30.0, 50.0)]
    got = [r["eta"] for r in analytics.eta(spark.createDataFrame(rows, "j int, t double, p double"), "j", "t", "p").orderBy("t").collect()]
    assert got == [None, 90.0, 80.0, pytest.approx(0.5 * 30 + 0.5 * 70)]


def test_contacts_need_cited_lines(spark):
    found = spark.createDataFrame([(1, "(022) 20-15-00", "A@b.md"), (2, "12", None), (3, None, "x@y.md")], "k int, phone string, email string")
    lines = spark.createDataFrame([(1, ["Tel. 022 201500", "scrieți la a@B.md"]), (2, ["12"]), (3, ["z@y.md"])], "k int, texts array<string>")
    assert [tuple(r) for r in answers.verified_contacts(found, lines, "k").collect()] == [(1, "(022) 20-15-00", "A@b.md")]
    quotes = spark.createDataFrame([("q", "ru", None), ("q", "ru", ""), ("r", "ro", None), ("s", "ru", "t")], "quote string, quote_lang string, translation string")
    assert [tuple(r) for r in answers.untranslated(quotes, F.lit("ro")).collect()] == [("q", "ru")]


def test_evaluation_sets(spark):
    pytest.importorskip("yaml")
    text = "- {id: a, query: 'one?', query_lang: ro, other: 1}\n- {id: b, query: 'two?', is_negative: true}\n- {id: c, query: 'three?', exclude_from_metric: true}\n"
    cases = readers.evaluation_cases(spark, text)
    assert cases.count() == 3 and [r["id"] for r in readers.measured(cases).collect()] == ["a"]
    assert readers.evaluation_cases(spark, "").count() == 0


def test_tables_and_places_of_chunks(spark):
    none: list = []
    rows = [[f"r{i}", "x" * 300] for i in range(20)]
    blocks = [(1, 0, "heading", 1, "T", "ro", none, none, None, None, 1, [[1.0]], False), (1, 1, "paragraph", None, "Text " * 60, "ro", ["T"], none, None, None, 1, [[2.0]], True), (1, 2, "table", None, "", "ro", ["T"], none, ["a", "b"], rows, 2, None, None)]
    kinds = "doc_id long, id long, type string, level int, text string, lang string, section array<string>, legal_path array<string>, header array<string>, rows array<array<string>>, page int, boxes array<array<double>>, has_contacts boolean"
    df = spark.createDataFrame(blocks, kinds).withColumn("text", F.when(F.col("type") == "table", "| a |").otherwise(F.col("text")))
    about = spark.createDataFrame([(1, "file", "Title", "decizie", "4/1", None)], "doc_id long, kind string, title string, doc_type string, number string, date string")
    got = documents.described_chunks(documents.chunked(df), df, about).orderBy("ord").collect()
    tables = [r for r in got if r["is_table"]]
    assert len(tables) > 1 and all(r["text"].startswith("| a | b |\n| --- | --- |\n") for r in tables) and [r["part"] for r in tables] == list(range(len(tables)))
    assert sum(r["text"].count("| r") for r in tables) == 20
    first = got[0]
    assert (first["block_ids"], first["pages"], first["boxes"], first["has_contacts"]) == ([0, 1], [1], [[1.0], [2.0]], True)
    assert first["citation_label"] == "Decizie nr. 4/1 › T" and first["embed_text"] == f"Title\n{first['citation_label']}\n{first['text']}"
    assert all(r["block_ids"] == [2] and r["pages"] == [2] and r["boxes"] == [] and not r["has_contacts"] for r in tables)
