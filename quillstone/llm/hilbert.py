"""Sharding along a Hilbert curve.

Metadata columns are quantised (numbers by approximate quantiles, strings by
exact ones: cut points are whole values), the cells are ordered by their index
on a Hilbert curve, and the ordered rows are cut into runs, so that a shard's
files cover a small box of all dimensions at once and filters on any of them
prune files. Built-in functions only: range partitioning sorts the keys, and
each task's number of rows and bytes, a row for each task, makes places global.

Defined results: a null in a dimension lies before all values; a null text has
no bytes; null and repeated ids are ordinary rows; ties on the curve are
ordered by doc_id, text CRC and size. Very long texts are rows of their size:
under `rows` they change nothing, under `bytes` a shard may be longer by one of
them. Each row gives one row of the output, and an empty table gives an empty
one. A column with the name of an output column gets input_ before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import cut


def ordinal(df: DataFrame, name: str) -> Column:
    """A value that orders like the column and has cut points: a double, or a string."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("string")


def _numbered(df: DataFrame, size: str, *order: str) -> DataFrame:
    """df sorted over all tasks, with __at and __task (a row's number in its task, and the task), __first, __rank and __before (rows, and the sum of `size`, of earlier tasks)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # a task's rows are numbered in order; the task is in the upper bits
    numbered = cut(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.spark_partition_id()))
    tasks = numbered.groupBy("__task").agg(F.count("*").alias("n"), F.min("__at").alias("__first"), F.sum(size).alias("total"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each task of the sort, whatever the number of rows
    tasks = tasks.select("__task", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__rank"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(tasks), "__task")


def string_edges(rows: DataFrame, name: str, n: int) -> list[str]:
    """The values at which the rows, ordered by the column, pass each n-th of all (at most n values, each once)."""
    counted = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("rows"))
    placed = _numbered(counted, "rows", "value")
    total = placed.agg(F.sum("rows")).first()[0]
    if not total:
        return []
    within = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("rows").over(within), F.lit(0))
    placed = placed.select("value", start.alias("start"), (start + F.col("rows")).alias("stop"))
    # a value is a cut point if the rows up to it begin a new n-th
    passed = placed.where(F.floor((F.col("start") - 1) * n / total) < F.floor((F.col("stop") - 1) * n / total))
    return [r["value"] for r in passed.select("value").orderBy("value").collect()]


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """The index of a cell on the Hilbert curve, with `bits` bits in each dimension (int columns).

    The axes are brought to the transposed index by exchanging or inverting
    low bits from the highest bit down, followed by a Gray code; the bits of
    all axes are then interleaved.
    """
    d = len(cells)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(d)]) if bits > 1 else None
    axes = F.array(*[c.cast("int") for c in cells])

    def turned(acc: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        own, first = F.get(acc, i), F.get(acc, F.lit(0))
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = F.transform(acc, lambda x, j: F.when(j == 0, x.bitwiseXOR(low)).otherwise(x))
        exchanged = F.transform(acc, lambda x, j: F.when((j == 0) | (j == i), x.bitwiseXOR(swap)).otherwise(x))
        return F.when(own.bitwiseAND(q) != 0, inverted).otherwise(F.when(i == 0, acc).otherwise(exchanged))

    if steps is not None:
        axes = F.aggregate(steps, axes, turned)
    # Gray code: each axis takes in those before it
    gray = F.aggregate(axes, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(x.bitwiseXOR(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))))

    def finished(gray: Column) -> Column:
        last = F.get(gray, F.lit(d - 1))
        turn = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc)) if bits > 1 else F.lit(0)
        return F.transform(gray, lambda x: x.bitwiseXOR(turn))

    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b")) for b in range(bits - 1, -1, -1) for i in range(d)])
    done = F.transform(F.array(gray), finished)[0]
    index = F.transform(F.array(done), lambda g: F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc * 2 + F.get(g, p["i"]).cast("long").bitwiseAND(F.pow(F.lit(2), p["b"]).cast("long")).__ne__(0).cast("long")))
    return index[0]


def _cell(edges: Column, value: Column) -> Column:
    """The number of cut points up to the value; 0 for null."""
    return F.coalesce(F.size(F.filter(edges, lambda e: e <= value)), F.lit(0))


def sharded(documents: DataFrame, dimensions: Sequence[str] = ("lang", "source", "n_chars"), shards: int = 16, bits: int = 6, law: str = "rows", columns: Sequence[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), curve and the other input columns of each row.

    law `rows`: the shards' numbers of rows are at most one apart; `bytes`:
    their sizes (UTF-8 bytes and 1 for each row) are nearly equal.
    dimensions that documents doesn't have are left out. columns: the input
    columns to carry (default: all; none for places alone); one that has the
    name of a column above gets input_ before it.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    dims = [c for c in dimensions if c in documents.columns]
    own = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")
    carried = {c: f"input_{c}" if c in own else c for c in (documents.columns if columns is None else columns) if c != "doc_id"}
    row = [F.struct(*carried).alias("__row")] if carried else []
    base = documents.select("doc_id", *row, (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), *[ordinal(documents, c).alias(f"__d{i}") for i, c in enumerate(dims)])
    rows = cut(base)
    # cut points: at most 2^bits of each dimension
    n = 1 << bits
    named = [f"__d{i}" for i in range(len(dims))]
    numbers = [c for c in named if rows.schema[c].dataType == T.DoubleType()]
    points = dict(zip(numbers, rows.approxQuantile(numbers, [k / n for k in range(1, n)], 0.25 / n), strict=True)) if numbers else {}
    cells = []
    for c in named:
        values = sorted({float(x) for x in points[c]}) if c in points else string_edges(rows, c, n - 1)
        edges = F.array(*[F.lit(x) for x in values]) if values else F.array().cast(f"array<{rows.schema[c].dataType.simpleString()}>")
        cells.append(_cell(edges, F.col(c)))
    placed = rows.withColumn("curve", curve_index(cells, bits) if cells else F.lit(0).cast("long"))
    order = ["curve", "doc_id", "text_crc32", "size"]
    numbered = _numbered(placed.select("doc_id", "size", "text_crc32", "curve", *["__row" for _ in row]), "size", *order)
    total = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranked = numbered.withColumn("rank", F.col("__at") - F.col("__first") + F.col("__rank"))
    if law == "rows":
        small, extra = divmod(total["n"], shards)
        # the first `extra` shards have a row more
        edge = extra * (small + 1)
        shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (small + 1))).otherwise(extra + F.floor((F.col("rank") - edge) / max(1, small)))
        slot = F.when(F.col("rank") < edge, F.pmod("rank", F.lit(small + 1))).otherwise(F.pmod(F.col("rank") - edge, F.lit(max(1, small))))
        out = ranked.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})
    else:
        within = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out = ranked.withColumn("__start", F.col("__before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        out = cut(out.withColumn("shard", F.floor(F.col("__start") * shards / max(1, total["bytes"])).cast("int")))
        firsts = out.groupBy("shard").agg(F.min("rank").alias("__start_rank"))
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("__start_rank"))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *[F.col("__row")[c].alias(name) for c, name in carried.items()])


def write(documents: DataFrame, path: str, **options) -> None:
    """Write the rows to path as Parquet, a folder for each shard, in the order of the curve."""
    sharded(documents, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
