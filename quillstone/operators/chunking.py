"""Blocks to chunks: headings carried on, text runs, word windows, tables split by a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_level, heading_path, normalize_whitespace, token_count


def with_headings(blocks: DataFrame, level: Column | None = None) -> DataFrame:
    """Blocks (doc, place, type, text) with the three titles in force; a title of a level ends those below it."""
    level = F.when(F.col("type") == "title", level if level is not None else heading_level(F.col("text"))).otherwise(0)
    w = Window.partitionBy("doc").orderBy("place")
    rows = blocks.withColumn("level", level)
    one = F.sum((F.col("level") == 1).cast("int")).over(w)
    rows = rows.withColumn("__1", one).withColumn("__2", F.sum(F.col("level").between(1, 2).cast("int")).over(w))
    title = lambda n, scope: F.coalesce(F.last(F.when(F.col("level") == n, normalize_whitespace(F.col("text"), False)), ignorenulls=True).over(Window.partitionBy("doc", *scope).orderBy("place")), F.lit(""))
    rows = rows.withColumns({"level1_title": title(1, []), "level2_title": title(2, ["__1"]), "level3_title": title(3, ["__2"])})
    return rows.drop("__1", "__2").withColumn("heading_path", heading_path(F.col("level1_title"), F.col("level2_title"), F.col("level3_title")))


def text_runs(blocks: DataFrame) -> DataFrame:
    """Consecutive text blocks as one text; titles and tables end a run. Blocks need their heading_path."""
    w = Window.partitionBy("doc").orderBy("place")
    plain = F.col("type").isin("text", "list")
    rows = blocks.withColumn("run", F.sum((~plain).cast("int")).over(w)).where(plain & (F.trim("text") != ""))
    item = F.struct("place", "text")
    return rows.groupBy("doc", "run", "heading_path").agg(F.min("place").alias("first_place"), F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n").alias("text"))


def table_contexts(blocks: DataFrame, most: int = 800) -> DataFrame:
    """Tables with the last text before them, cut to so many characters."""
    before = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("type").isin("text", "list"), F.col("text")), ignorenulls=True).over(before)
    return blocks.withColumn("table_context_text", F.substring(F.coalesce(last, F.lit("")), 1, most)).where(F.col("type") == "table")


def word_windows(texts: DataFrame, text: str, size: int = 200, step: int = 160) -> DataFrame:
    """Windows of `size` words every `step` words: chunk_index, n_words, content; the last one reaches the end."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    rows = texts.withColumn("__words", parts).where(F.size("__words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("__words") - size) / step)).cast("int"))
    rows = rows.withColumn("chunk_index", F.explode(starts))
    window = F.slice("__words", F.col("chunk_index") * step + 1, size)
    return rows.withColumn("n_words", F.size(window)).withColumn("content", F.array_join(window, " ")).drop("__words")


def budget_chunks(texts: DataFrame, key: str, text: str, budget: int = 1024, overlap: int = 200) -> DataFrame:
    """The fallback splitter: words are added while the chunk's tokens stay in the budget, and `overlap` words come again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, t in zip(rows[key], rows[text], strict=True):
                parts = (t or "").split()
                # characters up to and with each word, with a space after it
                ends = np.cumsum([len(w) + 1 for w in parts])
                start = n = 0
                while start < len(parts):
                    base = ends[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(ends, base + 4 * budget + 1, side="right")))
                    out.append((k, n, " ".join(parts[start:end])))
                    n += 1
                    if end >= len(parts):
                        break
                    start = max(start + 1, end - overlap) if overlap > 0 else end
            yield pd.DataFrame(out, columns=[key, "chunk_index", "content"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, content string")


def markdown(rows: Column) -> Column:
    """A table (array<array<string>>) as Markdown: blank rows dropped, rows padded to the widest."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: normalize_whitespace(c, False))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    padded = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    rule = line(F.array_repeat(F.lit("---"), width))
    lines = F.concat(F.transform(F.slice(padded, 1, 1), line), F.array(rule), F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line))
    return F.when(F.size(clean) > 0, F.array_join(lines, "\n")).otherwise("")


#: What stands for a row that can't be made to fit.
OVERSIZE = "[row too long]"


def split_table(rows: Column, budget: int = 7000) -> Column:
    """array<array<array<string>>>: parts of a table within the token budget, each with the header row.

    A fold over the body's rows: a row that would go over the budget starts a
    new part. The cost is that of the Markdown of a part. A row that is over
    the budget with the header alone has its longest cell cut to four fifths of
    what the budget leaves; if that isn't enough, a mark stands for it.
    """
    line = lambda r: token_count(F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    head = F.slice(rows, 1, 1)
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    # the header and the rule below it
    base = F.coalesce(line(F.get(head, F.lit(0))) + line(F.transform(F.get(head, F.lit(0)), lambda _: F.lit("---"))), F.lit(0))

    def fitting(row: Column) -> Column:
        longest = F.array_max(F.transform(row, F.length))
        room = F.floor(4 * (budget - base) * 0.8 - (F.length(F.array_join(row, " | ")) - longest)).cast("int")
        cut = F.transform(row, lambda c: F.when(F.length(c) == longest, F.substring(c, F.lit(1), F.greatest(room, F.lit(0)))).otherwise(c))
        marked = F.transform(row, lambda c, i: F.when(i == 0, F.lit(OVERSIZE)).otherwise(F.lit("")))
        return F.when(base + line(row) <= budget, row).when((room > 0) & (base + line(cut) <= budget), cut).otherwise(marked)

    none = F.struct(F.array(head).alias("parts"), base.cast("int").alias("cost"))

    def step(acc: Column, row: Column) -> Column:
        parts, last = acc["parts"], F.element_at(acc["parts"], -1)
        own = line(row)
        grown = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(last, F.array(row))))
        fresh = F.concat(parts, F.array(F.concat(head, F.array(row))))
        fits = (acc["cost"] + own <= budget) | (F.size(last) == 1)
        return F.struct(F.when(fits, grown).otherwise(fresh).alias("parts"), F.when(fits, acc["cost"] + own).otherwise(base + own).cast("int").alias("cost"))

    return F.when(F.size(rows) > 0, F.aggregate(F.transform(body, fitting), none, step, lambda acc: acc["parts"]))


#: Where a text is parted, the first that it holds; the last is between any two characters (fixed values).
SEPARATORS = ("\n\n", "\n", "。", "；", "！", "？", "，", "、", ".", ";", "!", "?", ",", " ", "")


def _merged(parts: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of adjoining parts of at most `size` tokens; a run begins with the last parts of the one before it, up to `overlap` tokens."""
    out: list[tuple[int, int]] = []
    first = 0
    for n, (start, stop) in enumerate(parts):
        begin = parts[first][0]
        if first < n and stop - begin > 4 * size:
            out.append((begin, start))
            while first < n and (start - parts[first][0] > 4 * overlap or stop - parts[first][0] > 4 * size):
                first += 1
    return [*out, (parts[first][0], parts[-1][1])] if parts else out


def _cut(start: int, stop: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """_merged() of single characters."""
    step = 4 * size - min(4 * overlap, 4 * size - 1)
    starts = range(start, max(start + 1, stop - 4 * size + step), step)
    return [(a, min(a + 4 * size, stop)) for a in starts]


def split_offsets(text: str, size: int = 1024, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS, start: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """Places (start, stop) of the parts of a text, of at most `size` tokens (4 characters each), cut at the coarsest separator that serves; it stays at the beginning of what follows it."""
    stop = len(text) if stop is None else stop
    at = next(i for i, s in enumerate(separators) if not s or text.find(s, start, stop) >= 0)
    sep = separators[at]
    if not sep:
        return [x for x in _cut(start, stop, size, overlap) if text[x[0] : x[1]].strip()] if stop > start else []
    places, found = [start], text.find(sep, start, stop)
    while found >= 0:
        if found > start:
            places.append(found)
        found = text.find(sep, found + 1, stop)
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for a, b in zip(places, [*places[1:], stop], strict=True):
        if b - a <= 4 * size:
            run.append((a, b))
        else:
            out += _merged(run, size, overlap) + split_offsets(text, size, overlap, separators[at + 1 :], a, b)
            run = []
    return [x for x in out + _merged(run, size, overlap) if text[x[0] : x[1]].strip()]


def split_recursively(text: str, size: int = 1024, overlap: int = 200) -> list[str]:
    """The parts of split_offsets()."""
    return [text[a:b] for a, b in split_offsets(text, size, overlap)]


def recursive_spans(text: Column, size: int = 1024, overlap: int = 200) -> Column:
    """array<struct<start, stop>>: split_offsets() of a text, from 0."""

    @F.pandas_udf("array<struct<start: int, stop: int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in split_offsets(t, size, overlap)] if t else [] for t in texts], dtype="object")

    return spans(text)


def recursive_parts(text: Column, size: int = 1024, overlap: int = 200) -> Column:
    """array<string>: the parts of a text with its white space in order."""
    flat = normalize_whitespace(text)
    parts = F.transform(recursive_spans(flat, size, overlap), lambda x: normalize_whitespace(F.substring(flat, x["start"] + 1, x["stop"] - x["start"])))
    return F.filter(parts, lambda x: x != "")


def page_range(pages: Column) -> Column:
    """First and last of the pages that are known (0 or more); -1 and -1 without any."""
    known = F.filter(pages, lambda p: p >= 0)
    return F.struct(F.coalesce(F.array_min(known), F.lit(-1)).alias("first"), F.coalesce(F.array_max(known), F.lit(-1)).alias("last"))


def with_pages(parts: DataFrame, sources: DataFrame, *keys: str, width: int = 4096) -> DataFrame:
    """parts (keys, part, start, stop) with pages: the first and last page of the sources (keys, start, stop, page_idx) that each overlaps.

    Both are places in the same text. They meet by a join on the stretches of
    `width` characters that they touch, so no part is compared with all sources.
    """
    touched = lambda df: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest("stop", F.col("start") + 1) - 1) / width))))
    own = touched(parts.select(*keys, "part", "start", "stop"))
    other = touched(sources.where("page_idx >= 0").select(*keys, "start", "stop", "page_idx")).withColumnsRenamed({"start": "__start", "stop": "__stop"})
    met = own.join(other, [*keys, "__bin"]).where((F.col("__start") < F.col("stop")) & (F.col("__stop") > F.col("start")))
    pages = met.groupBy(*keys, "part").agg(F.min("page_idx").alias("first"), F.max("page_idx").alias("last"))
    none = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c)
    return parts.join(pages, [*keys, "part"], "left").withColumn("pages", F.struct(none("first"), none("last"))).drop("first", "last")


def structured_chunks(blocks: DataFrame, size: int = 1024, overlap: int = 200, table_budget: int = 7000) -> DataFrame:
    """Chunks of parsed documents from blocks (doc, place, type, text, page_idx, rows, table_id).

    chunk_id ({doc}_chunk_{n}), chunk_index, chunk_type, content, page_idx,
    page_range (a-b), the titles in force, table_id, sub_table_id,
    table_header_text and table_context_text. A title of a level begins a new
    text, a table ends one; texts are split recursively, tables by their budget
    with the header in each part.
    """
    heads = ["level1_title", "level2_title", "level3_title", "heading_path"]
    rows = with_headings(blocks)
    w = Window.partitionBy("doc").orderBy("place")
    ends = (F.col("type") == "table") | ((F.col("type") == "title") & (F.col("level") > 0))
    rows = rows.withColumn("run", F.sum(ends.cast("int")).over(w))
    texts = rows.where((F.col("type") != "table") & (normalize_whitespace(F.col("text"), False) != ""))
    texts = texts.withColumn("text", normalize_whitespace(F.col("text"), False))
    before = Window.partitionBy("doc", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # where each source begins in the run's text, in which a line break stands between two
    sources = texts.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).withColumn("stop", F.col("start") + F.length("text"))
    runs = texts.groupBy("doc", "run").agg(F.min("place").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "\n").alias("text"), *[F.max_by(h, "place").alias(h) for h in heads])
    parts = runs.select("doc", "run", "place", *heads, "text", F.posexplode(recursive_spans(F.col("text"), size, overlap)).alias("part", "x")).select("doc", "run", "place", *heads, "part", "x.*", normalize_whitespace(F.substring("text", F.col("x.start") + 1, F.col("x.stop") - F.col("x.start"))).alias("content")).where("content <> ''")
    parts = with_pages(parts, sources, "doc", "run", width=4 * size)
    text = parts.select("doc", "place", "part", *heads, F.lit("text").alias("chunk_type"), "content", F.col("pages.first").alias("page_idx"), F.concat_ws("-", "pages.first", "pages.last").alias("page_range"), *[F.lit("").alias(n) for n in ("table_id", "sub_table_id", "table_header_text")])
    tables = rows.where((F.col("type") == "table") & (F.size("rows") > 0)).select("doc", "place", *heads, "page_idx", "table_id", F.posexplode(split_table(F.col("rows"), table_budget)).alias("part", "rows"))
    table = tables.select("doc", "place", "part", *heads, F.lit("table").alias("chunk_type"), markdown(F.col("rows")).alias("content"), F.col("page_idx").cast("int").alias("page_idx"), F.concat_ws("-", "page_idx", "page_idx").alias("page_range"), "table_id", F.concat_ws("_", "table_id", F.col("part") + 1).alias("sub_table_id"), F.array_join(F.get("rows", F.lit(0)), " | ").alias("table_header_text")).where("content <> ''")
    out = text.unionByName(table)
    order = Window.partitionBy("doc").orderBy("place", "part")
    before = F.last(F.when(F.col("chunk_type") == "text", F.col("content")), ignorenulls=True).over(order)
    context = F.when(F.col("chunk_type") == "table", F.substring(normalize_whitespace(F.coalesce(before, F.lit("")), False), 1, 800)).otherwise("")
    out = out.withColumn("table_context_text", context).withColumn("chunk_index", F.row_number().over(order) - 1)
    return out.withColumn("chunk_id", F.concat_ws("_chunk_", F.col("doc").cast("string"), "chunk_index")).drop("place", "part")


def embedded(chunks: DataFrame, embedder, text: str = "content", dim: int = 1024) -> DataFrame:
    """Chunks with embedding (array<double> of unit length): of an embedder (texts -> vectors, a batch at a time, in order), fitted to dim places."""
    from ..functions.vectors import fitted

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in embedder(texts.fillna("").tolist())], dtype="object")

    return chunks.withColumn("embedding", vectors(text)).withColumn("embedding", fitted(F.col("embedding"), dim))
