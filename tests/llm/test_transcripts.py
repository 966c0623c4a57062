from __future__ import annotations

import itertools

import numpy as np
import pytest

from lectern.llm import transcripts as C


def model(seed: int = 0) -> C.Model:
    r = np.random.default_rng(seed)
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return C.Model(norm(r.random(3)), norm(r.random((3, 3))), norm(r.random((3, C.OBSERVATIONS))))


def score(m, obs, states):
    return m.start[states[0]] + sum(m.emit[s, o] for s, o in zip(states, obs, strict=True)) + sum(m.move[a, b] for a, b in itertools.pairwise(states))


def test_blocks_give_the_best_path():
    r = np.random.default_rng(1)
    for seed in range(40):
        m, obs = model(seed), r.integers(0, C.OBSERVATIONS, 7)
        best = max(score(m, obs, s) for s in itertools.product(range(3), repeat=7))
        for cuts in ([7], [2, 5, 7], [1, 2, 3, 4, 5, 6, 7]):
            parts = np.split(obs, cuts[:-1])
            ends = C.borders([C.reduced(p, m, i == 0) for i, p in enumerate(parts)])
            path = np.concatenate([C.decoded(p, m, b, e) for p, b, e in zip(parts, [-1, *ends[:-1]], ends, strict=True)])
            assert score(m, obs, path) == pytest.approx(best)


def test_markers(spark):
    lines = ["User: hi", "**AI**: yes", "[agent] ok", "<|system|> be kind", "### Human: x", "Note: this", "plain", "A: b", "http://x", "Q: why?"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in df.select(C.marker_kind(df["line"])).collect()]
    assert [C.KINDS[k] for k in got] == ["user", "assistant", "assistant", "system", "user", "none", "none", "assistant", "none", "user"]


@pytest.mark.parametrize("block_lines,parts,size", [(1, 1, "sf0.001"), (7, 1, "sf0.001"), (4096, 1, "sf0.001"), (4096, 6, "sf0.1"), (20, 6, "sf0.1")])
def test_roles_of_held_out_conversations(spark, block_lines, parts, size):
    talks = spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").repartition(parts)
    lines = C.lines_of(C.as_transcript(talks), "conv_id", ["turn"], "text", "role")
    m = C.fit(lines.filter("_key % 5 != 0"))
    parsed = C.parse(lines, m, block_lines).collect()
    assert len(parsed) == lines.count()
    # block by block it is the plain Viterbi path of the whole conversation
    seen = {}
    for r in lines.select("_key", "_at", "_line", "role", C.observation(lines["_line"]).alias("o")).collect():
        seen.setdefault(r["_key"], []).append((list(r["_at"]), r["_line"], r["o"], r["role"]))
    got = {}
    for r in parsed:
        got.setdefault(r["_key"], []).append((r["_block"], r["_row"], r["_line"], r["role"]))
    right = total = 0
    for key, rows in seen.items():
        rows.sort(key=lambda x: (x[0], x[1]))
        obs = np.array([x[2] for x in rows])
        end = C.borders([C.reduced(obs, m, True)])[0]
        want = [C.ROLES[s] for s in C.decoded(obs, m, -1, end)]
        mine = sorted(got[key])
        assert [x[2] for x in mine] == [x[1] for x in rows]
        path = [C.ROLES.index(x[3]) for x in mine]
        assert score(m, obs, path) == pytest.approx(score(m, obs, [C.ROLES.index(w) for w in want]))
        if key % 5 == 0:
            right += sum(w == x[3] for w, x in zip(want, rows, strict=True))
            total += len(rows)
    assert right >= 0.8 * total


def test_turns_and_odd_rows(spark):
    rows = [(1, 0, "user", "User: hi\nthere"), (1, 1, "assistant", "Assistant: yes"), (1, 2, "user", None), (None, 0, "user", "x"), (2, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    lines = C.lines_of(df, "conv_id", ["turn"], "text", "role")
    m = C.fit(lines)
    got = sorted((r["_key"], r["turn"], r["role"], r["text"], r["n_lines"]) for r in C.turns(C.parse(lines, m)).collect())
    assert [g[:2] for g in got if g[0] == 1][:2] == [(1, 0), (1, 1)] and sum(g[4] for g in got) == lines.count()
    assert got[0][3] == "hi\nthere" and got[1][3].startswith("yes")
    none = C.lines_of(df.limit(0), "conv_id", ["turn"], "text", "role")
    assert C.turns(C.parse(none, C.fit(none))).count() == 0


def test_blocks_have_a_bounded_number_of_lines(spark):
    rows = [(1, 0, "user", "User: hi"), (1, 1, "assistant", "\n".join(f"line {i}" for i in range(30_000))), (1, 2, "user", "thanks"), (1, 2, "user", "thanks")]
    rows += [(k, t, "user", "a\nb") for k in (2, 3) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    lines = C.lines_of(df, "conv_id", ["turn"], "text", "role")
    got = C._in_blocks(lines, 100).groupBy("_key", "_block").count().collect()
    assert max(r["count"] for r in got) == 100 and len(got) == 301 + 2 * 60
    parsed = C.parse(lines, C.fit(lines), 100)
    assert parsed.count() == 30_003 + 12_000
    one = [r["_line"] for r in parsed.filter("_key = 1").orderBy("_block", "_row").collect()]
    assert one == ["User: hi", *(f"line {i}" for i in range(30_000)), "thanks", "thanks"]


def test_roles_without_markers(spark, sf):
    """Unmarked transcripts: roles come from moves and kinds of lines alone, and must beat the commonest role."""
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    plain = C.lines_of(talks, "conv_id", ["turn"], "text", "role")
    m = C.fit(plain.filter("_key % 5 != 0"))
    held = plain.filter("_key % 5 = 0")
    truth = held.select("_key", "_at", "_line", "role").collect()
    got = {}
    for r in C.parse(held.drop("role"), m).collect():
        got.setdefault(r["_key"], []).append((r["_block"], r["_row"], r["role"]))
    right, roles = 0, {}
    by_key = {}
    for r in sorted(truth, key=lambda r: (r["_key"], list(r["_at"]), r["_line"])):
        by_key.setdefault(r["_key"], []).append(r["role"])
        roles[r["role"]] = roles.get(r["role"], 0) + 1
    for key, want in by_key.items():
        right += sum(w == g[2] for w, g in zip(want, sorted(got[key]), strict=True))
    assert right >= max(roles.values())
