"""Expressions against literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import acts, texts, urls, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("url,want", [("HTTP://Example.com:80//a//b?utm_source=x&b=2&a=1#top", "http://example.com/a/b?a=1&b=2"), ("https://e.com", "https://e.com/"), ("https://e.com:8443/x", "https://e.com:8443/x"), ("ftp://e.com/x", None), ("mailto:a@b.c", None), ("https://e.com/?q", "https://e.com/?q="), (None, None)])
def test_canonical(spark, url, want):
    assert one(spark, url, urls.canonical) == want


@pytest.mark.parametrize("url,want", [("https://www.E.com/a/", "e.com/a"), ("http://e.com", "e.com/"), ("http://e.com/a?x=1", "e.com/a?x=1")])
def test_key(spark, url, want):
    assert one(spark, url, urls.key) == want


@pytest.mark.parametrize("url,ext,document,skipped", [("http://e.com/a/File.PDF?x", ".pdf", True, False), ("http://e.com/a.b/c", "", False, False), ("http://e.com/.htaccess", "", False, False), ("http://e.com/p.png", ".png", False, True), ("http://e.com/wp-admin/x", "", False, True), ("http://e.com/a?month=3", "", False, True)])
def test_kinds_of_links(spark, url, ext, document, skipped):
    assert (one(spark, url, urls.extension), one(spark, url, urls.is_document), one(spark, url, urls.is_skipped)) == (ext, document, skipped)


def test_hosts_prefixes_and_links(spark):
    assert one(spark, "https://docs.google.com/d/1", urls.is_external_document_host) and not one(spark, "https://notlegis.md/x", urls.is_external_document_host)
    under = lambda p: one(spark, p, lambda c: urls.under_prefix(c, F.lit("/a/")))
    assert under("/a/b") and under("/a") and not under("/ab")
    html = '<a class=x href="/b">1</a><A HREF=\'c.html\'>2</A><a href="//o.md/z">3</a><a href="#top">4</a><a href="javascript:x()">5</a>'
    df = spark.createDataFrame([(html, "https://e.md:81/d/p.html")], "h string, u string").select("u", F.explode(urls.links(F.col("h"))).alias("l"))
    assert [r[0] for r in df.select(urls.resolved(F.col("l"), F.col("u"))).collect()] == ["https://e.md:81/b", "https://e.md:81/d/c.html", "https://o.md/z", None]


@pytest.mark.parametrize("text,want", [("Bună ziua și mulțumesc", "ro"), ("Добрый день", "ru"), ("Добрий день, їжак і ґанок", "uk"), ("the cost of the permit is", "en"), ("123 — !", None)])
def test_detected_language(spark, text, want):
    assert one(spark, text, texts.detected_language) == want


@pytest.mark.parametrize("code,text,want", [("ru-RU", "", "ru"), ("RON", "", "ro"), ("en_US", "", "en"), ("de", "Добрый день", "ru"), (None, "", "ro"), ("xx", "the and of", "en")])
def test_language_code(spark, code, text, want):
    df = spark.createDataFrame([(code, text)], "c string, t string")
    assert df.select(texts.language_code(F.col("c"), F.col("t"))).first()[0] == want


def test_contacts_and_masking(spark):
    text = "Tel. (022) 20-15-00, 0 22 123 456; www.info@primaria.md și b@c.md, b@c.md"
    assert one(spark, text, texts.has_contacts)
    assert one(spark, text, texts.emails) == ["info@primaria.md", "b@c.md"]
    assert one(spark, "scrieți la a.b@c.md sau 022 201 500", texts.masked) == "scrieți la ••• sau •••"
    assert len(one(spark, "x" * 300, texts.masked)) == 200
    assert one(spark, "Cum obțin  un permis?! ", texts.question_key) == "cum obțin un permis"
    assert one(spark, "Cum obțin un permis de construcție?", texts.qualifies) and not one(spark, "scurt", texts.qualifies)


@pytest.mark.parametrize("text,want", [("Cum obțin un permis de construcție?", ["obțin", "permis", "construcție"]), ("ce e la", ["ce", "la"]), ("где (получить) справку!", ["получить", "справку"])])
def test_query_terms(spark, text, want):
    assert one(spark, text, texts.query_terms) == want


@pytest.mark.parametrize("text,want", [("Ţara  şi\tapă ", "Țara și apă"), ("Mоldova", "Moldova"), ("молoко", "молоко"), ("мoлoкo", "мoлoкo"), ("a b", "a b")])
def test_normalised(spark, text, want):
    assert one(spark, text, texts.normalised) == want


def test_folding_and_tables(spark):
    assert one(spark, "Știri ÎN Chișinău", texts.unaccented) == "Stiri IN Chisinau"
    df = spark.createDataFrame([(["a", "b"], [["1"], ["2", "3", "4"]])], "h array<string>, r array<array<string>>")
    assert df.select(texts.markdown_table(F.col("h"), F.col("r"))).first()[0] == "| a | b |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | 3 | 4 |"


@pytest.mark.parametrize("text,kind,numbers,date", [("DECIZIE nr. 12/14 din 28 iulie 2020", "decizie", ["12/14"], "2020-07-28"), ("Распоряжение № 373-д от 25 августа 2026", "dispozitie", ["373-д"], "2026-08-25"), ("Legea nr.436 din 28.12.2006", "lege", ["436"], "2006-12-28"), ("hotarare-nr-5-din-31.02.2024", "hotarare", ["5"], "2024-02-31"), ("fără act 01.01.1980", None, [], None)])
def test_act_metadata(spark, text, kind, numbers, date):
    assert (one(spark, text, acts.act_type), one(spark, text, acts.act_numbers), one(spark, text, acts.act_date)) == (kind, numbers, date)


def test_reconciled_numbers(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(acts.reconciled_number(F.col("a"), F.col("b"))).first()[0]
    assert f("decizie nr 1214", "DECIZIE nr. 12/14") == "12/14" and f("decizie", "nr. 7") == "7" and f("nr. 9", "nr. 7") == "9"


@pytest.mark.parametrize("text,want", [("Anexa nr. 1", (0, "Anexa nr. 1")), ("ANEXA", (0, "Anexa")), ("Приложение № 2", (0, "Приложение № 2")), ("Capitolul IV", (1, "Capitolul IV")), ("Secțiunea 2", (2, "Secțiunea 2")), ("Articolul 5. Scop", (3, "Articolul 5")), ("Art. 14 din Legea 436", None), ("art. 14", (3, "Art. 14")), ("Ст. 14", (3, "Ст. 14")), ("pct. 12", (4, "pct. 12")), ("5.2. Text", (4, "pct. 5.2")), ("12. Text", (4, "pct. 12")), ("п. 3", (4, "п. 3")), ("(2) Text", (5, "alin. (2)")), ("часть 2", (5, "ч. (2)")), ("a) text", (6, "lit. a)")), ("подпункт b)", (6, "подп. b)")), ("12.03.2023 data", None), ("Text simplu", None), ("", None)])
def test_legal_items(spark, text, want):
    found = one(spark, text, acts.legal_item)
    assert (tuple(found) if found else None) == want


@pytest.mark.parametrize("claim,evidence,want", [("costă 8 000 lei", ["taxa 8000"], True), ("0,02%", ["0.02"], True), ("art. 4", ["din 01.04.2020"], True), ("5 zile", ["6 zile"], False), ("fără cifre", [], True)])
def test_numbers_backed(spark, claim, evidence, want):
    df = spark.createDataFrame([(claim, evidence)], "c string, e array<string>")
    assert df.select(acts.numbers_backed(F.col("c"), F.col("e"))).first()[0] is want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.96), None, None]
    assert df.select(vectors.normalised(F.col("a"))).first()[0] == [pytest.approx(0.6), pytest.approx(0.8)]


def test_character_references(spark):
    import html

    texts_ = ["a &amp; b", "&#233;&#xE9;&eacute;", "&amp;lt; &bad; & &#0; &#x110000; &copy;&nbsp;x", "none", "&#128512;", "&hellip;&mdash;&laquo;&raquo;", "&;&#;&#x;"]
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    got = [r[0] for r in df.select(texts.unescaped(F.col("t"))).collect()]
    assert got[:2] == [html.unescape(t) for t in texts_[:2]] and got[3:] == [html.unescape(t) for t in texts_[3:]]
    assert got[2] == "&lt; &bad; & &#0; &#x110000; ©\xa0x"
