"""Bytes cut anywhere give the same events; live sentences keep their order and wait for their lines."""

from __future__ import annotations

import json
import random

from lectern.streaming import usage
from lectern.streaming.frames import Frames, Live, Ordered, events_of_bytes

STREAM = "event: delta\r\ndata: {\"text\": \"Știri și țări\"}\r\n\r\ndata: a\ndata:b\n\n: note\n\nid: 7\nevent: done\n\nevent: x\ndata: 日本語😀\n\nevent: open\ndata: never".encode()
WANT = [("delta", '{"text": "Știri și țări"}'), ("message", "a\nb"), ("done", ""), ("x", "日本語😀")]


def test_frames_are_the_same_for_every_cut():
    assert Frames().feed(STREAM) == WANT
    for cut in range(len(STREAM) + 1):
        a, b = Frames(), None
        found = a.feed(STREAM[:cut])
        b = Frames(json.loads(json.dumps(a.state())))  # as the state of a stream has it
        assert found + b.feed(STREAM[cut:]) == WANT
    f, found = Frames(), []
    for i in range(len(STREAM)):
        found += f.feed(STREAM[i : i + 1])
    assert found == WANT
    assert Frames().feed(b"data: \xff\xc8\n\n") == [("message", "��")]


def test_chunks_wait_for_their_turn():
    r = random.Random(5)
    for _ in range(50):
        order, out = Ordered(), []
        for i in r.sample(range(20), 20):
            order = Ordered(json.loads(json.dumps(order.state())))
            out += order.put(i, str(i))
            out += order.put(i, "twice") if r.random() < 0.2 and i < order.next else []
        assert out == [str(i) for i in range(20)]


ANSWER = {"verdict": "answered", "sentences": [{"refs": ["L1", "L9"], "text": " First. "}, {"refs": [], "text": "bare"}, {"refs": ["L2"], "text": "Second."}, {"refs": ["L3"], "text": "  "}, {"refs": ["L1"], "text": "Third."}]}


def told(live: Live, steps: list) -> list[tuple]:
    out = []
    for kind, value in steps:
        out += live.line(value) if kind == "line" else live.piece(value) if kind == "piece" else live.give_up()
    return out


def joined(events: list[tuple]) -> list[tuple]:
    """Events with the deltas of a sentence as one."""
    out: list[tuple] = []
    for e in events:
        if out and e[0] == out[-1][0] == "delta" and e[1] == out[-1][1]:
            out[-1] = ("delta", e[1], out[-1][2] + e[2])
        else:
            out.append(e)
    return out


FIRST = [("citation", 0, "L1"), ("delta", 0, "First. "), ("sentence", 0, "First. ")]
SECOND = [("citation", 1, "L2"), ("delta", 1, "Second."), ("sentence", 1, "Second.")]
THIRD = [("delta", 2, "Third."), ("sentence", 2, "Third.")]


def test_sentences_in_the_order_of_the_answer():
    text = json.dumps(ANSWER)
    for n in (1, 2, 7, 1000):
        pieces = [("piece", text[i : i + n]) for i in range(0, len(text), n)]
        known = [("line", x) for x in ("L1", "L2", "L3")]
        assert joined(told(Live(), known + pieces)) == FIRST + SECOND + THIRD
        late = Live()
        assert told(late, pieces) == []
        late = Live(json.loads(json.dumps(late.state())))
        assert told(late, [("line", "L2")]) == []  # the first sentence waits, and so do those after it
        assert joined(told(late, [("line", "L1")])) == FIRST + SECOND + THIRD
        assert told(late, [("late", None)]) == []


def test_what_never_comes_is_left_out():
    live = Live()
    assert told(live, [("piece", json.dumps(ANSWER)), ("line", "L2")]) == []
    assert joined(told(live, [("late", None)])) == [("citation", 0, "L2"), ("delta", 0, "Second."), ("sentence", 0, "Second.")]
    refused = Live()
    assert told(refused, [("line", "L1"), ("piece", json.dumps({**ANSWER, "verdict": "not_found"}))]) == []


def test_connections_of_a_group_are_kept_together(spark, tmp_path):
    whole = "".join(f"event: delta\r\ndata: {json.dumps({'text': t})}\r\n\r\n" for t in ('{"role": "us', 'er", "te', 'xt": "a \\"b\\" \\\\', '"}')) + "event: done\n\n"
    want = [("text", "role", "us"), ("text", "role", "er"), ("value", "role", "user"), ("text", "text", 'a "b" \\'), ("value", "text", 'a "b" \\'), ("end", "", ""), ("done", "", "")]
    ids = ["a", "b", "null", None, "d\"'"]
    rows = [(i, at // (7 + n), whole[at : at + 7 + n].encode()) for n, i in enumerate(ids) for at in range(0, len(whole), 7 + n)]
    for batch in range(3):  # out of order, and one chunk in every batch
        part = [r for r in rows if (r[1] + len(r[0] or "")) % 3 == batch] + rows[:1]
        spark.createDataFrame(part, "id string, seq long, chunk binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
    stream = spark.readStream.schema("id string, seq long, chunk binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/chunks")
    for groups in (None, 2):
        found = usage.drained(events_of_bytes(stream, groups), "append").collect()
        got = {i: [tuple(r)[2:] for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["no"])] for i in ids}
        assert got == dict.fromkeys(ids, want) and len(found) == len(ids) * len(want)
