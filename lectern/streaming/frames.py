"""Streams of bytes read as they arrive: server-sent events cut anywhere, the JSON that they carry, and sentences shown once what they cite is known.

State of a connection is what is not yet complete: the bytes of an open line, the fields of an open frame, open JSON, and chunks that came before their turn. The
events are the same however the bytes are cut into chunks and the chunks into batches.

Defined results: a frame that is never ended by a blank line gives nothing; bytes that are no UTF-8 are replaced, line by line; a missing chunk holds back those after it;
a chunk that comes twice counts once; null chunks are empty.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.streaming.json_events import Event, Reader

#: Connections whose state is kept together.
TOGETHER = 64
#: How long a sentence waits for the lines that it cites.
PATIENCE_MS = 60_000


class Frames:
    """Server-sent events of a growing sequence of bytes."""

    def __init__(self, state: list | None = None):
        line, self.event, self.data = state or ["", None, []]
        self.line = base64.b64decode(line)

    def state(self) -> list:
        return [base64.b64encode(self.line).decode(), self.event, self.data]

    def feed(self, chunk: bytes) -> list[tuple[str, str]]:
        out = []
        *lines, self.line = (self.line + chunk).split(b"\n")
        for raw in lines:
            line = raw.removesuffix(b"\r").decode("utf-8", "replace")
            if not line:
                if self.data or self.event:
                    out.append((self.event or "message", "\n".join(self.data)))
                self.event, self.data = None, []
                continue
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                self.event = value
            elif name == "data":
                self.data.append(value)
        return out


class Ordered:
    """Chunks in their order from 0; early ones wait."""

    def __init__(self, state: list | None = None):
        self.next, early = state or [0, {}]
        self.early = {int(k): v for k, v in early.items()}

    def state(self) -> list:
        return [self.next, self.early]

    def put(self, seq: int, text: str) -> list[str]:
        if seq >= self.next:
            self.early[seq] = text
        out = []
        while self.next in self.early:
            out.append(self.early.pop(self.next))
            self.next += 1
        return out


class Connection:
    """The JSON events of `delta` frames, and other frames as they are, of one sequence of chunks."""

    def __init__(self, state: list | None = None):
        order, frames, reader, self.n = state or [None, None, "", 0]
        self.order, self.frames, self.reader = Ordered(order), Frames(frames), Reader(reader)

    def state(self) -> list:
        return [self.order.state(), self.frames.state(), self.reader.state(), self.n]

    def put(self, seq: int, chunk: bytes) -> list[tuple[int, Event]]:
        found: list[Event] = []
        for held in self.order.put(seq, base64.b64encode(chunk).decode()):
            for event, data in self.frames.feed(base64.b64decode(held)):
                found += self.reader.feed(json.loads(data)["text"]) if event == "delta" else [(event, "", data)]
        self.n += len(found)
        return list(zip(range(self.n - len(found), self.n), found, strict=True))


def _frames(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {i: s for i, s in json.loads(state.get[0])} if state.exists else {}
    met: dict[str | None, Connection] = {}
    rows: list[tuple] = []
    for part in parts:
        for ident, seq, chunk in zip(part["id"], part["seq"], part["chunk"], strict=True):
            if ident not in met:
                met[ident] = Connection(held.get(ident))
            rows += [(ident, n, *found) for n, found in met[ident].put(int(seq), chunk or b"")]
    held |= {i: c.state() for i, c in met.items()}
    state.update((json.dumps(list(held.items())),))
    if rows:
        yield pd.DataFrame(rows, columns=["id", "no", "event", "path", "value"])


def events_of_bytes(chunks: DataFrame, groups: int | None = None) -> DataFrame:
    """id, no, event, path, value: the JSON events of the texts of `delta` frames, and other frames as they are, of chunks (id string, seq long from 0, chunk binary).

    A call for one connection's news costs more than the news of many, so connections are dealt to `groups` that are called and kept as one; without it, each is its own. A
    group's state is written whole when any of its connections has news: about `TOGETHER` of them are right where most have some. `groups` stays as it is while the stream lives.
    """
    group = F.col("id") if groups is None else F.pmod(F.xxhash64("id"), F.lit(groups))
    dealt = chunks.select("id", "seq", "chunk", group.alias("_group"))
    return dealt.groupBy("_group").applyInPandasWithState(_frames, "id string, no long, event string, path string, value string", "held string", "append", GroupStateTimeout.NoTimeout)


class Live:
    """Sentences of an answer that is being written, shown when a line that they cite is known.

    A sentence is streamed as soon as it has text and a known line; one whose lines are not known yet waits, and so do those after it, so the order stays.
    """

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.live, self.known, self.sent, self.index = s.get("live", False), set(s.get("known", [])), set(s.get("sent", [])), s.get("index", 0)
        #: number, lines, text, text shown so far (null before it is shown), closed
        self.queue: list[list] = s.get("queue", [])
        self.reader = Reader(s.get("reader", ""))

    def state(self) -> dict:
        return {"live": self.live, "known": sorted(self.known), "sent": sorted(self.sent), "index": self.index, "queue": self.queue, "reader": self.reader.state()}

    def line(self, ref: str) -> list[tuple]:
        self.known.add(ref)
        return self._show()

    def piece(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        for kind, path, value in self.reader.feed(text):
            at = path.split("/")
            if kind == "value" and path == "verdict":
                self.live = value in ("answered", "partial")
            elif self.live and len(at) >= 2 and at[0] == "sentences":
                n = int(at[1])
                if not self.queue or self.queue[-1][0] != n:
                    self.queue.append([n, [], "", None, False])
                entry = self.queue[-1]
                if kind == "value" and at[2:3] == ["refs"] and len(at) == 4:
                    entry[1].append(value)
                elif kind == "text" and at[2:] == ["text"]:
                    entry[2] += value
                elif kind == "end" and len(at) == 2:
                    entry[4] = True
                out += self._show()
        return out

    def give_up(self) -> list[tuple]:
        """Closed sentences that wait for lines are left out."""
        out: list[tuple] = []
        while self.queue and self.queue[0][4]:
            self.queue.pop(0)
            out += self._show()
        return out

    def _show(self) -> list[tuple]:
        out: list[tuple] = []
        while self.queue:
            entry = self.queue[0]
            _, refs, text, shown, closed = entry
            valid = [r for r in dict.fromkeys(refs) if r in self.known]
            if shown is None and text.strip() and valid:
                shown = ""
                text = entry[2] = text.lstrip()
            if shown is not None:
                out += [("citation", self.index, r) for r in valid if r not in self.sent]
                self.sent.update(valid)
                if len(text) > len(shown):
                    out.append(("delta", self.index, text[len(shown) :]))
                entry[3] = text
                if not closed:
                    return out
                out.append(("sentence", self.index, text))
                self.index += 1
            elif not closed or text.strip() and refs:
                return out  # open, or its lines may come
            self.queue.pop(0)
        return out


def _live(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, order, n = json.loads(state.get[0]) if state.exists else [None, None, 0]
    live, order = Live(held), Ordered(order)
    rows: list[tuple] = []
    if state.hasTimedOut:
        rows += live.give_up()
    else:
        for part in parts:
            for kind, seq, value in zip(part["kind"], part["seq"], part["value"], strict=True):
                for text in [value] if kind == "line" else order.put(int(seq), value or ""):
                    rows += live.line(text) if kind == "line" else live.piece(text)
    state.update((json.dumps([live.state(), order.state(), n + len(rows)]),))
    if any(entry[4] for entry in live.queue):
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + PATIENCE_MS)
    yield pd.DataFrame({"id": key[0], "no": range(n, n + len(rows)), "event": [r[0] for r in rows], "index": [r[1] for r in rows], "value": [r[2] for r in rows]}).astype({"no": "int64", "index": "int64"})


def live_answers(pieces: DataFrame, lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """id, no, event (citation, delta or sentence), index, value: two streams met for each answer.

    pieces: id, seq from 0, value (a piece of the answer's JSON), at; lines: id, value (a line that was shown to the writer), at.
    """
    both = pieces.select("id", F.lit("piece").alias("kind"), "seq", "value", "at").unionByName(lines.select("id", F.lit("line").alias("kind"), F.lit(0).cast("long").alias("seq"), "value", "at"))
    timed = both.withWatermark("at", late)
    return timed.groupBy("id").applyInPandasWithState(_live, "id string, no long, event string, index long, value string", "held string", "append", GroupStateTimeout.EventTimeTimeout)
