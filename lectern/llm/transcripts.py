"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A transcript is a table of lines in order. What a line shows (a speaker marker that opens it, a closing question mark, its
length) is the observation, the role of its speaker the hidden state. Start, transition and emission counts come from
transcripts with known roles, by grouped sums over all of them with add-one smoothing.

Viterbi decoding is split so that a transcript of any length is never held in one task: blocks of lines are reduced to
max-plus matrices of the best scores between states, the short list of a transcript's matrices fixes the states at the
block borders, and blocks are then decoded on their own. Turn numbers come from per-block counts.

Defined results: a null text is one empty line; a transcript without lines is absent; ties go to the earlier role of ROLES; lines with an equal
position are taken in the order of their text; rows with a null transcript key are left out; unknown roles are left out of the counts; an
empty training table gives uniform scores; columns other than those named are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import shared_dir

ROLES = ("system", "user", "assistant")
BLOCK_LINES = 2048
SPAN = 1024
#: Names that open a line, by what they hint at.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent"),
}
MARKER = r"^\s*(?:#+\s*|\*\*|<\|?|\[)?([A-Za-z]{1,12})(?:\*\*)?\s*(?::(?:\*\*)?|\|?>|\])\s*"
KINDS = ("system", "user", "assistant", "none")
OBSERVATIONS = len(KINDS) * 2 * 3


def _name(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, MARKER, 1))


def marker_kind(line: Column) -> Column:
    """0 to 2: a marker of that role; 3: no known marker."""
    kind = F.lit(len(ROLES))
    for i, role in enumerate(ROLES):
        kind = F.when(_name(line).isin(*MARKERS[role]), F.lit(i)).otherwise(kind)
    return kind


def observation(line: Column) -> Column:
    """An integer below OBSERVATIONS."""
    asks = F.rtrim(line).endswith("?").cast("int")
    long = F.when(F.length(line) < 40, 0).when(F.length(line) < 160, 1).otherwise(2)
    return ((marker_kind(line) * 2 + asks) * 3 + long).cast("int")


def lines_of(turns: DataFrame, key: str, order: list[str], text: str, *keep: str) -> DataFrame:
    """One row a line: _key, _at (an array that sorts lines), _line, and the kept columns."""
    at = [F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in order]
    cut = turns.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[a.alias(f"_o{i}") for i, a in enumerate(at)], *keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_o", "_line"))
    return cut.select("_key", F.array(*[f"_o{i}" for i in range(len(at))], F.col("_o").cast("long")).alias("_at"), "_line", *keep)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray  # from role to role
    emit: np.ndarray  # role by observation

    @staticmethod
    def of(starts: dict[int, int], moves: dict[tuple[int, int], int], emits: dict[tuple[int, int], int]) -> Model:
        n = len(ROLES)
        a, b, c = np.ones(n), np.ones((n, n)), np.ones((n, OBSERVATIONS))
        for k, v in starts.items():
            a[k] += v
        for k, v in moves.items():
            b[k] += v
        for k, v in emits.items():
            c[k] += v
        return Model(np.log(a / a.sum()), np.log(b / b.sum(1, keepdims=True)), np.log(c / c.sum(1, keepdims=True)))


def fit(lines: DataFrame, role: str = "role") -> Model:
    """Counts over all of `lines` (from `lines_of`, with known roles in `role`).

    Moves between lines of one turn and to the next turn are counted from sizes of turns, so no transcript is sorted:
    a turn of n lines stays n - 1 times, and its last line moves to the first line of the turn after it.
    """
    number = F.array_position(F.array(*map(F.lit, ROLES)), F.col(role)).cast("int") - 1
    known = lines.select("_key", F.slice("_at", 1, F.size("_at") - 1).alias("_turn"), number.alias("_role"), observation(F.col("_line")).alias("_obs")).filter("_role >= 0")
    emits = {(r[0], r[1]): r[2] for r in known.groupBy("_role", "_obs").count().collect()}  # at most roles x observations
    turns = known.groupBy("_key", "_turn").agg(F.min("_role").alias("_role"), F.count(F.lit(1)).alias("_n"))
    turns = turns.withColumn("_no", F.element_at("_turn", -1))
    after = turns.select("_key", (F.col("_no") - 1).alias("_no"), F.col("_role").alias("_next"))
    moves: dict[tuple[int, int], int] = {}
    for r in turns.groupBy("_role").agg(F.sum(F.col("_n") - 1)).collect():
        moves[r[0], r[0]] = r[1]
    for r in turns.join(after, ["_key", "_no"]).groupBy("_role", "_next").count().collect():
        moves[r[0], r[1]] = moves.get((r[0], r[1]), 0) + r[2]
    starts = {r[0]: r[1] for r in turns.filter("_no = 0").groupBy("_role").count().collect()}
    return Model.of(starts, moves, emits)


def reduced(obs: np.ndarray, model: Model, first: bool) -> np.ndarray:
    """Best score of a block by the state before it and the state of its last line; row 0 stands for the start in a first block."""
    n = len(ROLES)
    best = np.full((n, n), -np.inf)
    if first:
        best[0] = model.start + model.emit[:, obs[0]]
    else:
        best = model.move + model.emit[:, obs[0]][None]
    for o in obs[1:]:
        best = (best[:, :, None] + model.move[None]).max(1) + model.emit[:, o][None]
    return best


def decoded(obs: np.ndarray, model: Model, before: int, last: int) -> np.ndarray:
    """The best states of a block between the state before it (-1: it is the first) and the state of its last line."""
    score = (model.start if before < 0 else model.move[before]) + model.emit[:, obs[0]]
    back = []
    for o in obs[1:]:
        both = score[:, None] + model.move
        back.append(both.argmax(0))
        score = both.max(0) + model.emit[:, o]
    out = np.empty(len(obs), np.int64)
    out[-1] = last
    for i in range(len(obs) - 2, -1, -1):
        out[i] = back[i][out[i + 1]]
    return out


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The state of the last line of each block on the best path through all blocks."""
    score, back = matrices[0][0], []
    for m in matrices[1:]:
        both = score[:, None] + m
        back.append(both.argmax(0))
        score = both.max(0)
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _in_blocks(lines: DataFrame, block_lines: int) -> DataFrame:
    """`_block` of every line: its number in the transcript over `block_lines`, so a block has that many lines, whatever the sizes of turns.

    Numbers come from counts: those of ranges of SPAN leading positions, of positions in a range, and of lines at a position.
    """
    lines = lines.withColumn("_lead", F.element_at("_at", 1))
    counts = lines.groupBy("_key", F.floor(F.col("_lead") / SPAN).alias("_range"), "_lead").agg(F.count(F.lit(1)).alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("_key", "_range").agg(F.sum("_n").alias("_n"))
    ranges = ranges.select("_key", "_range", earlier(Window.partitionBy("_key").orderBy("_range")).alias("_before"))
    base = counts.withColumn("_in", earlier(Window.partitionBy("_key", "_range").orderBy("_lead"))).join(ranges, ["_key", "_range"])
    base = base.select("_key", "_lead", (F.col("_before") + F.col("_in")).alias("_base"))
    at = F.row_number().over(Window.partitionBy("_key", "_lead").orderBy("_at", "_line")) - 1
    numbered = lines.withColumn("_in", at).join(base, ["_key", "_lead"])
    return numbered.withColumn("_block", F.floor((F.col("_base") + F.col("_in")) / block_lines).cast("long")).drop("_lead", "_in", "_base")


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames cut so that no block is cut, and where the blocks begin (with the end). Rows come sorted by block."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        new = (frame["_key"].shift() != frame["_key"]) | (frame["_block"].shift() != frame["_block"])
        starts = np.flatnonzero(new.to_numpy())
        rest = frame.iloc[starts[-1] :].reset_index(drop=True)
        if starts[-1]:
            yield frame.iloc[: starts[-1]], starts.tolist()
    if rest is not None:
        yield rest, [0, len(rest)]


def _written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, for what is read more than once."""
    path = f"{shared_dir(df.sparkSession)}/transcripts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def parse(lines: DataFrame, model: Model, block_lines: int = BLOCK_LINES) -> DataFrame:
    """_key, _block, _row, _line, role (recovered) and opens (whether a turn begins) for every line of `lines_of`."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    kind = lines.schema["_key"].dataType.simpleString()
    n = len(ROLES)
    blocks = _in_blocks(lines.select("_key", "_at", "_line"), block_lines)
    blocks = _written(blocks.withColumn("_obs", observation(F.col("_line"))).withColumn("_mark", marker_kind(F.col("_line"))))
    sort = ["_key", "_block", "_at", "_line"]

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in _runs(frames):
            obs, first = frame["_obs"].to_numpy(), (frame["_block"] == 0).to_numpy()
            heads = frame.iloc[starts[:-1]]
            yield pd.DataFrame({"_key": heads["_key"], "_block": heads["_block"], "_m": [reduced(obs[a:b], shared.value, first[a]).ravel().tolist() for a, b in zip(starts, starts[1:], strict=False)]})

    matrices = blocks.repartition("_key", "_block").sortWithinPartitions(*sort).select("_key", "_block", "_obs").mapInPandas(reduce, f"_key {kind}, _block long, _m array<double>")

    def fix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one row a transcript; its list has one small matrix a block
        for frame in frames:
            rows = []
            for key, parts in zip(frame["_key"], frame["_ms"], strict=True):
                states = borders([np.asarray(p["_m"]).reshape(n, n) for p in parts])
                rows += [(key, p["_block"], b, s) for p, b, s in zip(parts, [-1, *states[:-1]], states, strict=True)]
            yield pd.DataFrame(rows, columns=["_key", "_block", "_before", "_last"])

    lists = matrices.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_block", "_m"))).alias("_ms"))
    fixed = lists.mapInPandas(fix, f"_key {kind}, _block long, _before int, _last int")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in _runs(frames):
            obs, before, last = (frame[c].to_numpy() for c in ("_obs", "_before", "_last"))
            states, rows, changed = [], [], []
            for a, b in zip(starts, starts[1:], strict=False):  # the row at a tells the borders of the block
                found = decoded(obs[a + 1 : b], shared.value, int(before[a]), int(last[a]))
                states.append(found)
                rows.append(np.arange(b - a - 1))
                changed.append(np.concatenate(([int(before[a])], found[:-1])) != found)
            states = np.concatenate(states)
            frame = frame.drop(frame.index[starts[:-1]])
            opens = np.concatenate(changed) | (frame["_mark"].to_numpy() == states)
            yield pd.DataFrame({"_key": frame["_key"].to_numpy(), "_block": frame["_block"].to_numpy(), "_row": np.concatenate(rows), "_line": frame["_line"].to_numpy(), "role": np.array(ROLES)[states], "opens": opens})

    # borders come as a first row of each block: a join by the keys of the repartition would stand in for it, and may become a broadcast that leaves lines where they are
    no = lambda c: F.lit(None).cast(blocks.schema[c].dataType).alias(c)
    heads = fixed.select("_key", "_block", no("_at"), no("_line"), F.lit(-1).alias("_obs"), F.lit(-1).alias("_mark"), "_before", "_last")
    met = blocks.withColumns({"_before": F.lit(-1), "_last": F.lit(-1)}).unionByName(heads).repartition("_key", "_block").sortWithinPartitions(*sort).drop("_at")
    return _written(met.mapInPandas(decode, f"_key {kind}, _block long, _row int, _line string, role string, opens boolean"))


def turns(parsed: DataFrame) -> DataFrame:
    """_key, turn, role, text (lines without their markers), n_lines: recovered turns, numbered from 0.

    Numbers come from counts of opening lines by block; only a block, and then a turn, is ever held together.
    """
    starts = parsed.groupBy("_key", "_block").agg(F.sum(F.col("opens").cast("long")).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = starts.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_key", "_block").orderBy("_row")
    rows = parsed.withColumn("_in", F.sum(F.col("opens").cast("long")).over(within))
    rows = rows.join(base, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")))
    bare = F.when(F.col("opens") & (marker_kind(F.col("_line")) < len(ROLES)), F.regexp_replace("_line", MARKER, "")).otherwise(F.col("_line"))
    turn = (F.col("_base") + F.col("_in") - 1).alias("turn")
    rows = rows.select("_key", turn, "role", F.struct("_block", "_row", bare.alias("_line")).alias("_x"))
    grouped = rows.groupBy("_key", "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list("_x")).alias("_xs"))
    return grouped.select("_key", "turn", "role", F.array_join(F.transform("_xs", lambda x: x["_line"]), "\n").alias("text"), F.size("_xs").cast("long").alias("n_lines"))


def rendered(role: Column, text: Column) -> Column:
    """A turn in its canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))


def as_transcript(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations written the way transcripts come: a marker style for each conversation, and one in eight turns unmarked."""
    styles = [("User: ", "Assistant: ", "System: "), ("Q: ", "A: ", "Context: "), ("**Human**: ", "**AI**: ", "**System**: "), ("[customer] ", "[agent] ", "[instructions] ")]
    h = F.xxhash64(key)
    style = F.pmod(h, F.lit(len(styles)))
    mark = F.lit("")
    for i, names in enumerate(styles):
        by_role = F.when(F.col(role) == "user", names[0]).when(F.col(role) == "assistant", names[1]).when(F.col(role) == "system", names[2]).otherwise("")
        mark = F.when(style == i, by_role).otherwise(mark)
    mark = F.when(F.pmod(F.xxhash64(key, turn), F.lit(8)) == 0, "").otherwise(mark)
    return conversations.select(key, turn, role, F.concat(mark, F.coalesce(F.col(text), F.lit(""))).alias(text))
