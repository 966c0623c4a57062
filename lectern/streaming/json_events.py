"""JSON read as it arrives: events of a growing text, the same however it is cut into pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Event = tuple[str, str, str]


class Reader:
    """Holds what is not yet complete: open containers, and the raw characters of an open string or literal."""

    def __init__(self, state: str = ""):
        self.path, self.raw, self.kind, self.shown = json.loads(state) if state else ([], "", "", 0)

    def state(self) -> str:
        return json.dumps([self.path, self.raw, self.kind, self.shown])

    def _at(self) -> str:
        return "/".join(str(p[1]) for p in self.path)

    def _whole(self) -> str:
        """The decoded text of the open string as far as its escapes are complete."""
        raw = self.raw
        for cut in range(0, 12):  # an open escape, or half of a surrogate pair, waits
            try:
                text = json.loads(f'"{raw[: len(raw) - cut]}"', strict=False)
            except ValueError:
                continue
            if not (text and 0xD800 <= ord(text[-1]) < 0xDC00):
                return text
        return ""

    def feed(self, text: str) -> list[Event]:
        out: list[Event] = []
        at = 0
        while at < len(text):
            if self.kind == "string":
                end = text.find('"', at)
                self.raw += text[at:] if end < 0 else text[at:end]
                if end < 0:
                    break
                at = end + 1
                if (len(self.raw) - len(self.raw.rstrip("\\"))) % 2:
                    self.raw += '"'
                else:
                    self._close(out)
                continue
            c = text[at]
            at += 1
            if self.kind == "literal" and (c in ',]}"{[:' or c.isspace()):
                out.append(("value", self._at(), self.raw))
                self.raw, self.kind = "", ""
            if c == '"':
                self.kind, self.raw, self.shown = "string", "", 0
            elif c in "{[":
                self.path.append([c, "" if c == "{" else 0, c == "{"])
            elif c in "}]":
                self.path.pop()
                out.append(("end", self._at(), ""))
            elif c == ",":
                top = self.path[-1]
                top[1], top[2] = ("", True) if top[0] == "{" else (top[1] + 1, False)
            elif c != ":" and not c.isspace():
                self.kind, self.raw = "literal", self.raw + c
        if self.kind == "string" and not self._key():
            self._show(out, self._whole())
        return out

    def _key(self) -> bool:
        return bool(self.path) and self.path[-1][2]

    def _show(self, out: list[Event], text: str) -> None:
        if len(text) > self.shown:
            out.append(("text", self._at(), text[self.shown :]))
            self.shown = len(text)

    def _close(self, out: list[Event]) -> None:
        text = json.loads(f'"{self.raw}"', strict=False)
        if self._key():
            self.path[-1][1], self.path[-1][2] = text, False
        else:
            self._show(out, text)
            out.append(("value", self._at(), text))
        self.raw, self.kind, self.shown = "", "", 0


def _run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, count = state.get if state.exists else ("", 0)
    reader, rows = Reader(held), []
    pieces = pd.concat(list(frames)).sort_values("seq")
    for piece in pieces["piece"]:
        for kind, path, value in reader.feed(piece):
            rows.append((key[0], count, kind, path, value))
            count += 1
    state.update((reader.state(), count))
    yield pd.DataFrame(rows, columns=["id", "no", "event", "path", "value"])


def events(pieces: DataFrame) -> DataFrame:
    """id, no, event (text, value or end), path, value of streams of pieces (id string, seq long, piece string)."""
    return pieces.groupBy("id").applyInPandasWithState(_run, "id string, no long, event string, path string, value string", "reader string, count long", "append", GroupStateTimeout.NoTimeout)


def live_sentences(found: DataFrame) -> DataFrame:
    """id and the sentences of finished or running answers so far: values at sentences/<n>/text, in order."""
    n = F.regexp_extract("path", r"^sentences/(\d+)/text$", 1)
    rows = found.filter((F.col("event") == "value") & (n != "")).select("id", n.cast("int").alias("n"), "value")
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("sentences"))
