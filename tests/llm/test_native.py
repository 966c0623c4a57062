"""The operators of column expressions only, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import secret_scan as S
from lectern.llm import sharding as H
from tests.llm import brute


def secret_texts() -> list[str | None]:
    r = random.Random(8)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    out: list[str | None] = [
        None, "", "token=secret: abcdefghijkl", "Password : 'short' PASSWD=longenough1", 'api_key="é" apikey=' + mixed(30), "token==abcdefgh", "AKIA" + "X" * 11, "AKIA" + "X" * 12 + "AKIA" + "Y" * 3,
        "é日😀 token=abcdefgh 😀", "f" * 31 + " " + "f" * 32, "see EXAMPLE" + mixed(30), "550e8400-e29b-41d4-a716-446655440000", "a-long-name-of-words-and-2024", mixed(40) + "." + mixed(60), "x" * 200 + "1",
    ]
    for _ in range(60):
        parts = [r.choice(["token", "Secret ", "plain", "api_key", "AKIA", hexes(r.randint(5, 50)), mixed(r.randint(5, 80)), "=", ": ", " ", "\n", '"', "é"]) for _ in range(r.randint(1, 25))]
        out.append("".join(parts))
    out.append("token=aaaaaaaa " * 700)
    out += [mixed(60) + "/sample/" + "a" * 40, "a" * 30 + "/sample/" + "b" * 30 + mixed(60), mixed(3000)]
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    table = S.weight_table(S.WINDOW)
    out = []
    for m in re.finditer(S.CANDIDATE, text):
        hit = m[0]
        if not re.search("[0-9]", hit) or not re.search("[A-Za-z]", hit) or any(re.search(p, hit) for p in S.ALLOW_LIST):
            continue
        runs: list[list[int]] = []
        for i in range(len(hit) - S.WINDOW + 1):
            w = hit[i : i + S.WINDOW]
            total = sum(table[c] for c in collections.Counter(w).values())
            bits = S.MIN_BITS["hex" if re.fullmatch("[0-9a-fA-F]+", w) else "mixed"]
            if total <= S.most_weight(S.WINDOW, bits) and len(re.findall("[0-9]", w)) >= 2 and not re.search(S.PLACEHOLDER, w) and re.search("[A-Za-z]", w):
                if runs and runs[-1][1] >= i:
                    runs[-1][1] = i + S.WINDOW
                else:
                    runs.append([i, i + S.WINDOW])
        out += [(m.start() + a, m.start() + b) for a, b in runs]
    return out


def test_secrets(spark):
    rows = list(enumerate(secret_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in S.digest_columns(S.scan(df)).collect()}
    for i, t in rows:
        base = brute.secrets(t)
        said = ",".join(f"{n}:{a}:{b}" for a, _, n, b in base)
        every = sorted(base + [(a, 3, "entropy", b) for a, b in entropy_spans(t or "")])
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (t, base)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert got[i]["spans"] == ",".join(f"{n}:{a}:{b}" for a, _, n, b in every)
    assert any("entropy" in g["spans"] for g in got.values())
    for i, t in rows[-3:]:  # a placeholder elsewhere in the candidate hides nothing
        assert "entropy" in got[i]["spans"], t
    named = df.selectExpr("doc_id", "text", "doc_id as secret_extra", "doc_id as secret_base")
    kept = S.scan(named).select("doc_id", "secret_extra", "secret_spans").collect()
    assert all(r["secret_extra"] == r["doc_id"] and S.KINDS.index("entropy") == 3 for r in kept)


def test_redaction(spark):
    rows = [(i, t, i) for i, t in enumerate(secret_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    out = S.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        text = rows[r["doc_id"]][1]
        if text is None:
            assert r["text"] is None
            continue
        cut, at = [], 0
        spans = sorted([(a, b) for a, _, _, b in brute.secrets(text)] + entropy_spans(text))
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            cut.append(text[at:a])
            at = b
        assert r["text"] == "[SECRET]".join([*cut, text[at:]])
    assert S.scan(df.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (S.digest_columns(S.scan(docs)), H.assign(docs), S.redact(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def uniform(key: str, shard: int) -> float:
    return (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13


@pytest.mark.parametrize("weights,sub_rows", [(None, 4096), ([1.0, 2.0, 0.5, 1.0], 7)])
def test_shards(spark, weights, sub_rows):
    n = 4
    rows = [(i, "text é" * (i % 5) if i % 7 else None, 1) for i in range(900)] + [(3, "again", 1), (3, "again", 1), (None, "no key", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    got = H.assign(df, shards=n, weights=weights, sub_rows=sub_rows).collect()
    assert len(got) == len(rows)
    w = [*(weights or [1.0] * n), 1.0]
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        score = [-math.log(uniform(key, s)) / w[s] for s in range(n + 1)]
        assert r["shard"] == min(range(n), key=lambda s: score[s]) and r["grown_shard"] == min(range(n + 1), key=lambda s: score[s])
        assert r["grown_shard"] in (r["shard"], n)
    for s in range(n):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    one = {r["doc_id"]: r for r in got}
    assert all((one[i]["size"], one[i]["text_crc32"]) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows if i != 3)


def test_shard_arguments(spark):
    with pytest.raises(ValueError, match="positive weight"):
        H.rendezvous(F.lit(1), 2, [1.0, 0.0])
    assert H.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [H.sub_buckets(n, 40) for n in (0, 1, 40 * 4096, 40 * 4096 + 1, 40 * 4096 * 5)] == [1, 1, 1, 2, 8]
