"""The Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from lectern.llm import merkle as M
from lectern.llm import queries as Q


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict, text: str | None) -> str:
    said = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in said])


def lowered(row: dict) -> str | None:
    t, i = row["text"], row["doc_id"]
    if t is None or i is None or zlib.crc32(str(i).encode()) % 3:
        return t
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def climb(nodes: list[str], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    while len(nodes) > 1:
        s = i - i % 8
        out.append((nodes[s:i], nodes[i + 1 : s + 8]))
        nodes, i = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], i // 8
    return out


def top(nodes: list[str]) -> str:
    while len(nodes) > 1:
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0]


def brute(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[g] = [leaf(r, r["text"]) for r in groups[g]]
    subroots = [top(trees[g]) for g in langs]
    root, out = top(subroots), []
    for n, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = climb(trees[g], i) + climb(subroots, n)
            node = leaf(r, lowered(r))
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in path for x in left + right])
            out.append((r["doc_id"], trees[g][i], subroots[n], root, proof, node, node == root))
    return sorted(out, key=repr)


def table() -> list[dict]:
    rows = [{"doc_id": i, "text": f"Text {'É' * (i % 3)} {i}" if i % 11 else None, "lang": "en" if i % 3 else ["de", "", None, "é", "zz"][i % 5], "source": f"s{i % 4}" if i % 7 else None, "n_chars": i if i % 13 else None} for i in range(700)]
    rows += [dict(rows[5])] * 20 + [{**rows[5], "text": "another"}, {**rows[5], "doc_id": None}, {**rows[7], "doc_id": None, "text": ""}]
    rows += [{"doc_id": 2**60 + k, "text": "UPPER", "lang": f"lone{k}", "source": "s", "n_chars": 5} for k in range(9)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHOWN = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df, **more) -> list[tuple]:
    m = M.build(df, changes=M.lower_every_third("doc_id", "text"), **more)
    return sorted([tuple(r) for r in M.audit(m).select(*SHOWN).collect()], key=repr)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_against_one_tree(spark, levels):
    rows = table()
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).repartition(5)
    assert found(df, levels=levels) == brute(rows)


def test_small_and_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    one = [{"doc_id": 3, "text": "Abc", "lang": None, "source": None, "n_chars": None}]
    df = spark.createDataFrame([(3, "Abc", None, None, None)], SCHEMA)
    got = found(df)
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3]
    eight = [{"doc_id": i, "text": "A" * 100_000 if i == 4 else "b", "lang": "en", "source": None, "n_chars": 1} for i in range(8)]
    named = spark.createDataFrame([(r["doc_id"], r["text"], "en", None, 1, "x", "y", 0) for r in eight], SCHEMA + ", leaf string, _g string, root int")
    assert found(named) == brute(eight)


def test_versions_share_all_but_their_ancestors(spark):
    df = spark.range(600).selectExpr("id as doc_id", "'T' || id as text", "'en' as lang", "'s' as source", "id as n_chars")
    m = M.build(df, changes=M.lower_every_third("doc_id", "text"), levels=2)
    rows = M.audit(m).collect()
    assert all(len(r["copies"]) == 4 and r["copies"][-1] == r["folded_root"] for r in rows)  # 600, 75, 10, 2, 1
    base = M.BlockTree([r["leaf"] for r in sorted(rows, key=lambda r: r["doc_id"])], lone=True)
    before = [list(x) for x in base.levels]
    for r in rows:
        own = M.copied(r["changed"], list(base.sides(r["doc_id"])))
        assert own == list(r["copies"])
        if r["changed"] == r["leaf"]:
            assert own == [base.levels[k][r["doc_id"] // 8**k] for k in range(1, 5)]
    assert base.levels == before
    assert {r["verified"] for r in rows} == {True, False}


def test_query(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in Q.op13_merkle_manifest(spark, sf).select(*SHOWN).collect()], key=repr)
    assert got == brute(rows)
