"""How the sources of a language differ: exact triangular divergences of their smoothed term frequencies.

1. Tasks count terms by language, source and term a few MB of text at a time;
   Spark adds the counts up, and keeps the terms of enough documents.
2. Frequencies are integers: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N
   the group's count of kept terms and V their number. A term that a group
   lacks has its zero baseline p0, which depends on the group alone.
3. Pairs of groups by Gustavson's row accumulation: kept cells are dealt out by
   term, so a task has the term-major index of its part of a language's terms.
   It takes one group after the other, scatters that group's terms through the
   index into a dense row with a place for each peer, and gives out those rows,
   never a posting pair. What a row gets for a term of both groups corrects the
   zero baselines f(p, p0'), f(p0, p') and f(p0, p0'), which a histogram of the
   groups' values gives for all terms at once. Spark adds the rows of the parts.

A part holds about CELLS cells, more for a language of many sources, so that
what it gives out is a small share of what it reads; rows of a language with
over some 3,000 sources are dealt out in blocks, so that a task's dense rows
stay within ROOM numbers. A common term is split among parts by no more than its
sources, and a hot source has one cell for each term, so no task gets more than
its part. All arithmetic is on integers.

Defined results: null text, lang and source are empty strings, which are a
language and a source like others; a group without terms has the frequencies of
the baseline; a language without kept terms has divergences 0. Very long texts
are counted in segments. Repeated rows are rows; ids are not read. Ties are
ordered by the item's bytes. No rows: no result. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut, lean, pieces, segments, utf8, words

SCALE = 1_000_000_000

#: Bytes of text that are counted at once.
TEXT = 4 << 20

#: Cells of a part, numbers of a task's dense rows, and posting pairs that are scattered at once.
CELLS = 1 << 16
ROOM = 8 << 20
SCATTERED = 1 << 20

#: Rows up to which the table of groups is broadcast; above it cells are salted.
BROADCAST_GROUPS = 100_000
SALTS = 64

#: Letters A-Z in lower case, other bytes below 128 that are no letters to blanks: what is left are terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of the text, term, how often) for each text of a piece and each of its terms."""
    raw, offsets = utf8(texts)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes().translate(_TERMS)))
    docs, terms, counts = [], [], []
    for part in segments(clean):
        bounds, codes, distinct = words(part)
        k = max(1, len(distinct))
        pairs, n = np.unique(np.repeat(np.arange(len(part)), np.diff(bounds)) * k + codes, return_counts=True)
        docs.append(pairs // k)
        terms.append(distinct.take(pa.array(pairs % k)))
        counts.append(n)
    if len(terms) == 1:
        return docs[0], terms[0], counts[0]
    # one long text in segments
    merged = pa.table({"t": pa.concat_arrays(terms), "n": np.concatenate(counts)}).group_by("t").aggregate([("n", "sum")])
    return np.zeros(len(merged), np.int64), merged.column("t").combine_chunks(), merged.column("n_sum").to_numpy()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        for first, texts in pieces(batch.column("text"), TEXT):
            docs, terms, counts = _counted(texts)
            group = [batch.column(c).slice(first, len(texts)).take(pa.array(docs)) for c in ("lang", "source")]
            table = pa.table({"lang": group[0], "source": group[1], "term": terms, "n": counts, "df": np.ones(len(docs), np.int64)})
            out = table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")]).rename_columns(["lang", "source", "term", "n", "df"])
            yield from out.to_batches(max_chunksize=1 << 16)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def accumulated(p0: np.ndarray, first: int, stop: int, source: np.ndarray, p: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two dense rows for each of the groups first to stop, with a place for each peer, over a part's terms of the group.

    The second has the sums of f(p, q0) - f(p0, q0), the group's own terms
    against the peer's baseline; the first has those and, for the terms of
    both, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). So the first row of a
    group and the second of its peer make the sum of f(p, q) - f(p0, q0).
    p0: the groups' baselines. source, p: the part's cells, term by term; new:
    true at a term's first cell.
    """
    rows = np.zeros((stop - first, len(p0)), np.int64)
    if not len(source):
        return rows, rows
    # histogram: how many terms have the value p in a group (p < 2^30)
    keys, m = np.unique((source << 30) | p, return_counts=True)
    held, value = keys >> 30, keys & ((1 << 30) - 1)
    bounds = np.searchsorted(held, np.arange(len(p0) + 1))
    ptr = np.append(np.flatnonzero(new), len(source))
    term = np.cumsum(new) - 1
    order = np.argsort(source, kind="stable")
    own = np.searchsorted(source[order], np.arange(len(p0) + 1))
    step, alone = max(1, SCATTERED // len(p0)), np.zeros_like(rows)
    for g in range(first, stop):
        row, base = rows[g - first], _f(p0[g], p0)
        for at in range(bounds[g], bounds[g + 1], step):
            part = slice(at, min(at + step, bounds[g + 1]))
            row += (m[part, None] * (_f(value[part, None], p0[None, :]) - base)).sum(axis=0)
        alone[g - first] = row
        mine = order[own[g] : own[g + 1]]
        length = (ptr[1:] - ptr[:-1])[term[mine]]
        done = np.cumsum(length)
        at = 0
        while at < len(mine):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + SCATTERED, side="right")))
            n, cells = length[at:end], mine[at:end]
            into = np.repeat(ptr[term[cells]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            peers, q, here = source[into], p[into], np.repeat(p[cells], n)
            np.add.at(row, peers, _f(here, q) - _f(here, p0[peers]) - _f(p0[g], q) + base[peers])
            at = end
    return rows, alone


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense rows of each (lang, block, part): first come the rows of its groups (no term), then its cells in the order of terms."""

    def finished(key: tuple, held: list) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        seed = pc.is_null(whole.column("term")).to_numpy()
        source, p = whole.column("idx").to_numpy().astype(np.int64), whole.column("p").to_numpy()
        terms = whole.column("term").filter(pa.array(~seed)).combine_chunks()
        if isinstance(terms, pa.ChunkedArray):
            terms = terms.chunk(0) if terms.num_chunks else pa.array([], pa.string())
        new = np.ones(len(terms), bool)
        new[1:] = pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)
        n = whole.column("rows")[0].as_py()
        first, stop = key[1] * n, min((key[1] + 1) * n, int(seed.sum()))
        both = accumulated(p[seed], first, stop, source[~seed], p[~seed], new)
        for at in range(0, stop - first, 64):
            some = [x[at : at + 64] for x in both]
            ends = pa.array(np.arange(len(some[0]) + 1, dtype=np.int32) * some[0].shape[1])
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(some[0]), pa.string()), pa.array(np.arange(first + at, first + at + len(some[0]), dtype=np.int32)), *lists], ["lang", "idx", "row", "alone"])

    key, held = None, []
    for batch in lean(batches):
        lang = pc.rank(batch.column("lang"), tiebreaker="dense").to_numpy().astype(np.int64)
        block, part = (batch.column(c).to_numpy().astype(np.int64) for c in ("block", "part"))
        edges = np.flatnonzero((lang[1:] != lang[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if a == b:
                continue
            found = (batch.column("lang")[a].as_py(), int(block[a]), int(part[a]))
            if found != key and held:
                yield from finished(key, held)
                held = []
            key = found
            held.append(batch.slice(a, b - a))
    if held:
        yield from finished(key, held)


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), in decimals, because the product can pass a long; null without terms."""
    wide = lambda c: c.cast("decimal(18,0)")
    share = F.call_function("div", wide(F.lit(SCALE)) * wide(count + 2), wide(n + 2 * v))
    return F.when(v > 0, F.lit(1).cast("long") + share)


def _few(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _joined(cells: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Cells with their group's columns: by broadcast, or salted by term, because a group can hold a third of all cells."""
    if few:
        return cells.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return cells.withColumn("__salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "__salt"]).drop("__salt")


class Audit:
    """Kept cells and groups of documents (text, lang, source), from which pairs() and terms() follow."""

    def __init__(self, documents: DataFrame, least: int = 10):
        docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
        counted = docs.mapInArrow(_cells, "lang string, source string, term string, n long, df long")
        cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        # at most a row for each source of the language
        by_term = Window.partitionBy("lang", "term")
        first = F.row_number().over(by_term.orderBy("source")) == 1
        kept = cells.withColumns({"n_lang": F.sum("n").over(by_term), "df": F.sum("df").over(by_term), "first": first}).where(F.col("df") >= least).drop("df")
        self.cells = cut(kept)
        by_lang = self.cells.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("n_all"), F.count("*").alias("cells"))
        by_group = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        of_lang = Window.partitionBy("lang")
        groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n", "v", "n_all", "cells"])
        groups = groups.withColumns({"idx": F.row_number().over(of_lang.orderBy("source")) - 1, "size": F.count("*").over(of_lang)})
        self.groups = cut(groups.withColumn("p0", _p(F.lit(0), F.col("n"), F.col("v"))))
        self.few = _few(self.groups)

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value: the sum of f over all kept terms."""
        rows = F.least(F.col("size"), F.greatest(F.lit(1), F.floor(F.lit(ROOM) / F.col("size")))).cast("long")
        per_part = F.greatest(F.lit(CELLS), 4 * F.col("rows") * F.col("size"))
        dealt = self.groups.withColumn("rows", rows).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("cells") / per_part)).cast("int"))
        dealt = dealt.withColumn("blocks", F.ceil(F.col("size") / F.col("rows")).cast("int"))
        info = dealt.select("lang", "source", "idx", F.col("n").alias("n_group"), "v", "rows", "parts", "blocks")
        cells = _joined(self.cells.select("lang", "source", "term", "n"), info, self.few)
        cells = cells.select("lang", "idx", "rows", "blocks", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part"), "term", _p(F.col("n"), F.col("n_group"), F.col("v")).alias("p"))
        if dealt.agg(F.max("blocks")).first()[0] in (None, 1):
            cells = cells.withColumn("block", F.lit(0))
        else:  # a term goes to the blocks of its groups
            own = F.collect_set(F.floor(F.col("idx") / F.col("rows")).cast("int")).over(Window.partitionBy("lang", "term"))
            cells = cells.withColumn("own", own).withColumn("block", F.explode("own"))
        seeds = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        columns = ["lang", "block", "part", "rows", "idx", "term", "p"]
        seeds = seeds.withColumns({"term": F.lit(None).cast("string"), "p": F.coalesce("p0", F.lit(1))}).select(*columns)
        dense = seeds.unionByName(cells.select(*columns)).repartitionByRange("lang", "block", "part").sortWithinPartitions("lang", "block", "part", F.col("term").asc_nulls_first(), "idx")
        partial = dense.mapInArrow(_rows, "lang string, idx int, row array<long>, alone array<long>")
        places = partial.select("lang", "idx", F.posexplode(F.arrays_zip("row", "alone")).alias("peer", "x")).where("idx <> peer")
        sides = F.array(F.struct("idx", "peer", F.col("x.row").alias("x")), F.struct(F.col("peer").alias("idx"), F.col("idx").alias("peer"), F.col("x.alone").alias("x")))
        summed = places.select("lang", F.inline(sides)).groupBy("lang", "idx", "peer").agg(F.sum("x").alias("x"))
        name = lambda idx, p0, *more: self.groups.select("lang", F.col("idx").alias(idx), F.col("source").alias(f"{idx}_source"), F.col("p0").alias(p0), *more)
        hint = F.broadcast if self.few else (lambda df: df)
        both = summed.join(hint(name("idx", "__p", "v")), ["lang", "idx"]).join(hint(name("peer", "__q")), ["lang", "peer"])
        zero = F.expr("((__p - __q) * (__p - __q)) div (__p + __q)")
        value = F.when(F.col("v") > 0, F.col("x") + F.col("v") * zero).otherwise(0).cast("long")
        return both.select("lang", F.col("idx_source").alias("source"), F.col("peer_source").alias("item"), value.alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item (a kept term that the group has, and has more often than its language), value."""
        info = self.groups.select("lang", "source", F.col("n").alias("n_group"), "v", "n_all")
        rows = _joined(self.cells.select("lang", "source", "term", "n", "n_lang"), info, self.few)
        rows = rows.select("lang", "source", F.col("term").alias("item"), _p(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), _p(F.col("n_lang"), F.col("n_all"), F.col("v")).alias("q"))
        return rows.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audited(documents: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and the `top` terms that set a source apart.

    least: documents of the language that a kept term occurs in.
    """
    audit = Audit(documents, least)
    by = [F.col("value").desc(), F.col("item")]
    group = Window.partitionBy("lang", "source").orderBy(*by)
    pairs = audit.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(group).alias("rank"))
    # the best of each salt first, so that a group never meets in one task
    salted = F.row_number().over(Window.partitionBy("lang", "source", "__salt").orderBy(*by))
    best = audit.terms().withColumn("__salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("__n", salted).where(F.col("__n") <= top)
    terms = best.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
