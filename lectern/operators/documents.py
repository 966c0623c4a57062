"""From parsed blocks to chunks and lines: section paths, legal paths, grouping, long texts, short neighbours."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.acts import citation_label, legal_item
from lectern.functions import let
from lectern.functions.texts import has_contacts, language_code, markdown_table

MERGE_CHARS, BLOCK_CHARS, OVERLAP_CHARS = 1500, 2500, 200
SHORT_CHARS, TAIL_CHARS, LEGAL_SHORT_CHARS = 150, 30, 300
LINE_MAX, LINE_TARGET, LINE_MIN = 400, 350, 25
ID_VERSION = "2"
LEVELS = 7
_BREAKS = re.compile(r"\n\n+|\n|(?<=[.!?])\s+")
_SPACES = re.compile(r"\s+")


def stacked(blocks: DataFrame, by: str, order: str, level: Column, label: Column, levels: int, clears: Column | None = None) -> Column:
    """The path of a stack that pops levels at or below each new item, as a window expression.

    For every level the last item before the row counts unless a higher level came after it; no row-by-row state is needed.
    `clears`: rows that drop levels from this one on.
    """
    w = Window.partitionBy(by).orderBy(order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    reach = before if clears is None else upto
    last = [F.max(F.when(level == i, F.struct(F.col(order).alias("at"), label.alias("label")))).over(reach) for i in range(levels)]
    cuts = [F.max(F.when(level < i, F.col(order))).over(reach) for i in range(levels)]
    if clears is not None:
        dropped = [F.max(F.when(clears <= i, F.col(order))).over(reach) for i in range(levels)]
        cuts = [F.greatest(c, d) for c, d in zip(cuts, dropped, strict=True)]
    alive = [F.when(x.isNotNull() & (cut.isNull() | (x["at"] >= cut)), x["label"]) for x, cut in zip(last, cuts, strict=True)]
    return F.filter(F.array(*alive), lambda t: t.isNotNull())


def with_sections(blocks: DataFrame, by: str = "doc_id", order: str = "id") -> DataFrame:
    """section: headings above a block. A heading's own section holds the headings above its level only."""
    level = F.when(F.col("type") == "heading", F.col("level"))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = {i: F.max(F.when(level == i, F.struct(F.col(order).alias("at"), F.col("text").alias("text")))).over(w) for i in range(1, 7)}
    cut = {i: F.max(F.when(level < i, F.col(order))).over(w) for i in range(1, 7)}
    alive = [F.when(last[i].isNotNull() & (cut[i].isNull() | (last[i]["at"] > cut[i])) & (level.isNull() | (level > i)), last[i]["text"]) for i in range(1, 7)]
    return blocks.withColumn("section", F.filter(F.array(*alive), lambda t: t.isNotNull()))


def with_legal_paths(blocks: DataFrame, by: str = "doc_id", order: str = "id", act: Column | None = None) -> DataFrame:
    """legal_path: the legal items that a block stands in, its own last. Below articles only in acts or documents with a major item.

    A heading ends items from points on.
    """
    item = legal_item(F.col("text"))
    marked = blocks.withColumn("_item", item)
    major = F.max((F.col("_item.level") <= 3).cast("int")).over(Window.partitionBy(by)) == 1
    allowed = F.coalesce(major, F.lit(False)) if act is None else act | F.coalesce(major, F.lit(False))
    marked = marked.withColumn("_item", F.when((F.col("_item.level") < 4) | allowed, F.col("_item")))
    clears = F.when(F.col("type") == "heading", F.lit(4))
    path = stacked(marked, by, order, F.col("_item.level"), F.col("_item.label"), LEVELS, clears)
    return marked.withColumn("legal_path", path).drop("_item")


def unit_ends(text: str, longest: int) -> list[int]:
    """Where the units of a text end: after line breaks, sentences and the spaces between, units of more than `longest` characters cut at words, longer words cut."""
    marks = sorted({0, len(text), *(p for m in _BREAKS.finditer(text) for p in m.span())})
    ends: list[int] = []
    for begin, end in pairwise(marks):
        if end - begin > longest:
            words = sorted({begin, end, *(p for m in _SPACES.finditer(text, begin, end) for p in m.span())})
            giants = {p for w in pairwise(words) if w[1] - w[0] > longest for p in w}
            at = begin
            while at < end:
                k = bisect_right(words, at + longest) - 1
                stop = next((p for p in words[bisect_right(words, at) : k + 1] if p in giants), words[k])
                at = stop if stop > at else min(at + longest, end)
                ends.append(at)
        else:
            ends.append(end)
    return ends


def split_long(text: str, target: int = MERGE_CHARS, most: int = BLOCK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Parts of about `target` characters, each beginning with the last `overlap` or more of the one before, in whole units.

    A part runs from its start to the first unit end `target` or more behind it, or to the one before if that is more than `most` away; the next part starts at
    the last unit end that leaves `overlap` characters.
    """
    if len(text) <= most:
        return [text]
    ends = [0, *unit_ends(text, target // 2)]
    parts, start, done = [], 0, 0
    while done < len(text):
        stop = bisect_left(ends, start + target)
        if stop == len(ends) or ends[stop] > start + most:
            stop -= 1
        done = ends[stop]
        parts.append(text[start:done].strip())
        start = ends[max(0, bisect_right(ends, done - overlap) - 1)]
    return list(filter(None, parts)) or [text]


def _joinable(a: dict, b: dict) -> bool:
    return not (a["is_table"] or b["is_table"]) and all(a[k] == b[k] for k in ("section", "legal_path", "lang"))


_SUB_ITEM = re.compile(r"^((?:pct\.|п\.|alin\.|ч\.|lit\.|подп\.)\s*\(?)(\d+(?:\.\d+)*|[a-zA-Zа-яА-Я])(\)?)", re.I)


def _item_run(chunks: list[dict]) -> list[dict]:
    """Neighbouring short legal items of one kind and parent as one chunk with a range for a label."""
    out: list[dict] = []
    for c in chunks:
        own = _SUB_ITEM.match(c["legal_path"][-1]) if c["legal_path"] and not c["is_table"] and len(c["text"]) < LEGAL_SHORT_CHARS else None
        last = out[-1] if out else None
        ok = own and last and last.get("_first") and last["_kind"] == own[1].strip().lower() and last["_parent"] == c["legal_path"][:-1]
        if ok and last["section"] == c["section"] and last["lang"] == c["lang"] and len(last["text"]) + 1 + len(c["text"]) <= MERGE_CHARS:
            first = last["_first"]
            label = f"{first[1]}{first[2]}{')' if first[3] and own[3] and '(' not in first[1] else ''}–{own[2]}{own[3]}"
            out[-1] = last | {"text": last["text"] + "\n" + c["text"], "last_block": c["last_block"], "part": 0, "legal_path": [*last["_parent"], label]}
        else:
            out.append(c | ({"_first": own, "_kind": own[1].strip().lower(), "_parent": c["legal_path"][:-1]} if own else {}))
    return out


def with_breaks(blocks: DataFrame, by: str = "doc_id", order: str = "id") -> DataFrame:
    """breaks: whether a block can't stand in one chunk with the block before it.

    In a chunk headings come first and nest; then come blocks of one section, legal path and language. A table stands alone.
    """
    w = Window.partitionBy(by).orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("type", "text", "lang", "section", "legal_path")}
    heading, after_heading = F.col("type") == "heading", before["type"] == "heading"
    nested = F.slice("section", 1, F.size(before["section"]) + 1) == F.concat(before["section"], F.array(before["text"]))
    foreign = (before["lang"] != "") & (F.col("lang") != "") & (before["lang"] != F.col("lang"))
    moved = (before["legal_path"] != F.col("legal_path")) | (before["section"] != F.col("section"))
    table = (F.col("type") == "table") | (before["type"] == "table")
    rule = F.when(heading, ~(after_heading & nested)).otherwise(foreign | ~after_heading & moved)
    return blocks.withColumn("breaks", before["type"].isNull() | table | rule)


def _groups(blocks: list[dict]) -> list[list[dict]]:
    """Blocks between breaks, and these cut where running lengths pass MERGE_CHARS; headings stay with what follows them while it fits."""
    sums = [0, *accumulate(len(b["text"]) + 2 for b in blocks)]
    stops = [i for i, b in enumerate(blocks) if b["breaks"]] + [len(blocks)]
    groups, start = [], 0
    for stop in stops:
        while start < stop:
            leading = next((i for i in range(start, stop) if blocks[i]["type"] != "heading"), stop)
            end = min(stop, max(start + 1, leading, bisect_right(sums, sums[start] + MERGE_CHARS) - 1))
            groups.append(blocks[start:end])
            start = end
    return groups


def _chunks(blocks: list[dict]) -> list[dict]:
    """Chunks of the blocks of one document, in order."""
    groups = _groups(blocks)
    chunks = []
    for g in groups:
        body = [b for b in g if b["type"] != "heading"]
        lead = body[0] if body else g[-1]
        section = lead["section"] if body else [*lead["section"], lead["text"]]
        path = next((b["legal_path"] for b in body if b["legal_path"]), g[0]["legal_path"])
        lang = next((b["lang"] for b in body if b["lang"]), g[0]["lang"])
        shared = {"section": section, "legal_path": path, "lang": lang, "first_block": g[0]["id"], "last_block": g[-1]["id"], "is_table": g[0]["type"] == "table"}
        text = "\n\n".join(b["text"] for b in g).strip()
        chunks += [shared | {"text": t, "part": i} for i, t in enumerate(g[0].get("parts") or split_long(text))]
    out: list[dict] = []
    for c in _item_run(chunks):
        last = out[-1] if out else None
        short = last and min(len(last["text"]), len(c["text"])) < SHORT_CHARS
        if short and _joinable(last, c) and len(last["text"]) + len(c["text"]) + 2 <= MERGE_CHARS:
            out[-1] = last | {"text": f"{last['text']}\n\n{c['text']}", "last_block": c["last_block"], "part": 0}
        else:
            out.append(c)
    return [c for c in out if c["is_table"] or len(c["text"].strip()) >= TAIL_CHARS]


CHUNK_COLUMNS = "ord int, text string, section array<string>, legal_path array<string>, lang string, first_block long, last_block long, part int, is_table boolean"


def chunked(blocks: DataFrame, by: str = "doc_id", order: str = "id") -> DataFrame:
    """Chunks of every document, with ids, hashes and contact flags.

    blocks: by, id, type (heading, paragraph, list_item or table), level, text, lang, section, legal_path, and header and rows if tables have them: a long
    table becomes groups of rows, each under the header. A document's blocks are packed into one row by a grouped collection (its size is the document's), and documents
    are cut on their own.
    """
    if {"header", "rows"} <= set(blocks.columns):
        typed = (F.col("type") == "table") & (F.size("rows") > 0)
        blocks = blocks.withColumn("parts", F.when(typed, table_chunks(F.col("header"), F.col("rows")))).withColumn("text", F.when(typed, F.array_join("parts", "\n\n")).otherwise(F.col("text")))
    else:
        blocks = blocks.withColumn("parts", F.lit(None).cast("array<string>"))
    clean = blocks.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    clean = with_breaks(clean.withColumn("lang", F.coalesce("lang", F.lit(""))), by, order)
    columns = [F.col(order).cast("long").alias("id"), "type", "text", "lang", "section", "legal_path", "breaks", "parts"]
    packed = clean.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_blocks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_COLUMNS.split(", ")]
        for frame in frames:
            rows = []
            for key, items in zip(frame[by], frame["_blocks"], strict=True):
                items = [{k: (list(v) if k in ("section", "legal_path", "parts") and v is not None else v) for k, v in x.items()} for x in items]
                rows += [{by: key, "ord": i} | {n: c[n] for n in names if n != "ord"} for i, c in enumerate(_chunks(items))]
            yield pd.DataFrame(rows, columns=[by, *names])

    found = packed.mapInPandas(run, f"{by} {blocks.schema[by].dataType.simpleString()}, {CHUNK_COLUMNS}")
    ident = F.sha1(F.concat_ws(":", F.col(by).cast("string"), "first_block", "last_block", "part", F.lit(ID_VERSION)))
    return found.withColumns({"chunk_id": ident, "content_hash": F.sha1("text"), "has_contacts": has_contacts(F.col("text")), "lang": language_code(F.col("lang"), F.col("text"))})


def described_chunks(chunks: DataFrame, blocks: DataFrame, about: DataFrame, by: str = "doc_id", order: str = "id") -> DataFrame:
    """`chunks` with block_ids, pages, boxes and contacts of the blocks from first_block to last_block, and with citation_label and embed_text.

    blocks: by, id, and page, boxes, has_contacts; about: one row a document with kind, title, doc_type, number, date. A block finds its chunk by one look back over the starts of the
    document's chunks, so no block meets all chunks; parts of one long text share their blocks.
    """
    spans = chunks.select(by, F.col("first_block").alias("_at"), F.col("last_block").alias("_last")).distinct()
    starts = spans.select(by, F.col("_at").alias("_id"), F.struct("_at", "_last").alias("_span"), F.lit(None).cast(blocks.select(F.struct(order, "page", "boxes", "has_contacts").alias("b")).schema["b"].dataType).alias("_b"))
    rows = blocks.select(by, F.col(order).cast("long").alias("_id"), F.lit(None).cast(starts.schema["_span"].dataType).alias("_span"), F.struct(order, "page", "boxes", "has_contacts").alias("_b"))
    back = Window.partitionBy(by).orderBy("_id", F.col("_b").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(rows).withColumn("_span", F.last("_span", ignorenulls=True).over(back)).filter("_b is not null and _id <= _span._last")
    held = met.groupBy(by, F.col("_span._at").alias("first_block")).agg(F.array_sort(F.collect_list(F.struct("_id", "_b"))).alias("_bs"))
    own = F.transform("_bs", lambda x: x["_b"])
    held = held.select(by, "first_block", F.transform("_bs", lambda x: x["_id"]).alias("block_ids"), pages_of(own).alias("pages"), boxes_of(own).alias("boxes"), F.exists("_bs", lambda x: F.coalesce(x["_b"]["has_contacts"], F.lit(False))).alias("_contacts"))
    full = chunks.join(held, [by, "first_block"], "left").join(about.select(by, "kind", "title", "doc_type", "number", "date"), by, "left")
    label = citation_label(F.col("kind"), F.col("title"), F.col("doc_type"), F.col("number"), F.col("date"), F.col("legal_path"), F.col("section"))
    named = full.withColumn("citation_label", label).withColumn("has_contacts", F.col("has_contacts") | F.coalesce("_contacts", F.lit(False)))
    return named.withColumn("embed_text", F.concat_ws("\n", F.coalesce("title", F.lit("")), "citation_label", "text")).drop("_contacts")


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Plain texts as blocks: one paragraph a line that is not blank."""
    trimmed = F.filter(F.transform(F.split(text, "\n", -1), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    cut = docs.select(key, F.col(lang).alias("lang"), F.posexplode(trimmed).alias("id", "text"))
    return cut.withColumns({"type": F.lit("paragraph"), "level": F.lit(None).cast("int"), "section": F.array().cast("array<string>"), "legal_path": F.array().cast("array<string>")})


def fine_lines(chunks: DataFrame, key: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines to search and cite: long ones cut at sentences and then words, short ones joined to the next, a short tail to the one before.

    All folds run inside one expression per chunk.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    filled = lambda a: F.filter(a, lambda t: t != "")
    raw = filled(F.transform(F.split(text, "\n", -1), strip))
    none = F.array().cast("array<string>")

    def packed(sentence: Column) -> Column:
        word_list = F.split(sentence, r"(?U)\s+")
        start = F.struct(none.alias("out"), F.lit("").alias("now"), F.lit(0).alias("size"))
        step = lambda a, w: F.when(
            (a["now"] != "") & (a["size"] + F.length(w) + 1 > LINE_TARGET), F.struct(F.concat(a["out"], F.array(a["now"])).alias("out"), w.alias("now"), F.length(w).alias("size"))
        ).otherwise(F.struct(a["out"].alias("out"), F.when(a["now"] == "", w).otherwise(F.concat_ws(" ", a["now"], w)).alias("now"), (a["size"] + F.length(w) + 1).alias("size")))
        return F.aggregate(word_list, start, step, lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))

    sentences = lambda t: F.flatten(F.transform(filled(F.transform(F.split(t, r"(?U)(?<=[.!?])\s+"), strip)), lambda s: F.when(F.length(s) > LINE_MAX, packed(s)).otherwise(F.array(s))))
    pieces = F.flatten(F.transform(raw, lambda t: F.when(F.length(t) > LINE_MAX, sentences(t)).otherwise(F.array(t))))
    start = F.struct(none.alias("out"), F.lit("").alias("held"))
    whole = lambda a, s: F.when(a["held"] == "", s).otherwise(F.concat_ws(" ", a["held"], s))
    joined = F.aggregate(
        pieces,
        start,
        lambda a, s: F.when(F.length(whole(a, s)) < LINE_MIN, F.struct(a["out"].alias("out"), whole(a, s).alias("held"))).otherwise(F.struct(F.concat(a["out"], F.array(whole(a, s))).alias("out"), F.lit("").alias("held"))),
        lambda a: F.when(a["held"] == "", a["out"])
        .when(F.size(a["out"]) == 0, F.array(a["held"]))
        .otherwise(F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.concat_ws(" ", F.element_at(a["out"], -1), a["held"])))),
    )
    cut = chunks.select(key, *keep, F.posexplode(joined).alias("idx", "line"))
    return cut.withColumns({"line_id": F.sha1(F.concat_ws(":", key, "idx")), "content_hash": F.sha1("line")})


def table_chunks(header: Column, rows: Column, target: int = MERGE_CHARS, most: int = BLOCK_CHARS) -> Column:
    """A table as Markdown texts: one if it has at most `most` characters, else groups of rows, each under the header and closed by the row that
    brings it to `target`.

    A group's length is its header's, its rows' and their padding to the group's widest row; folds over the lengths tell whether one text will do, and give the groups; texts are made once.
    """
    # a cell that is null is left out of its line
    width = lambda cells: F.aggregate(cells, F.lit(0), lambda n, c: n + F.coalesce(F.length(c) + 3, F.lit(0))) + 1
    sizes = F.struct(F.transform(rows, lambda r: F.struct((width(r) + 1).alias("chars"), F.size(r).alias("cells"))).alias("rows"), width(header).alias("chars"), F.size(header).alias("cells"))
    none = [F.lit(0).alias(c) for c in ("chars", "cells", "wide", "n")]

    def grown(a: Column, row: Column) -> list[Column]:
        return [(a["chars"] + row["chars"]).alias("chars"), (a["cells"] + row["cells"]).alias("cells"), F.greatest(a["wide"], row["cells"]).alias("wide"), (a["n"] + 1).alias("n")]

    def length(a: Column, head: Column) -> Column:
        columns = F.greatest(a["wide"], head["cells"])
        # padding of rows and header, and the line under the header: six characters a column and one
        return a["chars"] + 3 * (a["n"] * columns - a["cells"]) + head["chars"] + 3 * (columns - head["cells"]) + 1 + 6 * columns + 1

    def cut(ends: Column) -> Column:
        bounds = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(rows))))
        return let(bounds, lambda bs: F.transform(F.slice(bs, 2, F.size(bs)), lambda e, i: markdown_table(header, F.slice(rows, F.get(bs, i) + 1, e - F.get(bs, i)))))

    def groups(head: Column) -> Column:
        zero = F.struct(F.struct(*none).alias("g"), F.array().cast("array<int>").alias("ends"), F.lit(0).alias("i"))

        def step(a: Column, row: Column) -> Column:
            i = a["i"] + 1
            full = F.struct(F.struct(*none).alias("g"), F.concat(a["ends"], F.array(i)).alias("ends"), i.alias("i"))
            return let(F.struct(*grown(a["g"], row)), lambda g: F.when(length(g, head) >= target, full).otherwise(F.struct(g.alias("g"), a["ends"].alias("ends"), i.alias("i"))))

        return let(F.aggregate(head["rows"], zero, step, lambda a: a["ends"]), cut)

    def made(head: Column) -> Column:
        whole = F.aggregate(head["rows"], F.struct(*none), lambda a, row: F.struct(*grown(a, row)))
        return let(whole, lambda g: F.when(length(g, head) <= most, F.array(markdown_table(header, rows))).otherwise(groups(head)))

    return let(sizes, made)


def attributed(line: Column, blocks: Column) -> Column:
    """The first block (of an array of structs with `text`) that holds a line, or that the line holds; null if none does."""
    return F.get(F.filter(blocks, lambda b: F.contains(b["text"], line) | ((b["text"] != "") & F.contains(line, b["text"]))), 0)


def pages_of(blocks: Column) -> Column:
    """The distinct pages of a chunk's blocks, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(blocks, lambda b: b["page"]), lambda p: p.isNotNull())))


def boxes_of(blocks: Column) -> Column:
    """The boxes of all blocks of a chunk, block by block."""
    return F.flatten(F.transform(blocks, lambda b: F.coalesce(b["boxes"], F.array().cast("array<array<double>>"))))


def document_records(chunks: DataFrame, columns: list[str], by: str = "doc_id", order: str = "ord") -> DataFrame:
    """One row a document: the named columns of its first chunk, and its kind, from the id if the chunk has none."""
    first = chunks.groupBy(by).agg(F.min_by(F.struct("kind", *columns), order).alias("_c"))
    kind = F.coalesce("_c.kind", F.when(F.col(by).startswith("page:"), "page").otherwise("file"))
    return first.select(by, kind.alias("kind"), *[F.col(f"_c.{c}").alias(c) for c in columns])
