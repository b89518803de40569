"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words. A document of the source is wanted
target / source_size times: a whole number of copies for sure, and one more
with the fraction that is left. The fractions are rounded together: two
documents are paired, and words (fraction times size) move from one to the
other, in a direction drawn so that neither expectation changes, until one of
them is integral. The words of a pair are the same before and after, so a
source's total is kept exactly, down to its last fractional document.

Pairs are found by a reduction tree: each source's documents are dealt by hash
into chunks of about FAN, a chunk is folded from its longest to its shortest
document and leaves one fractional document at most, and those are dealt into
FAN times fewer chunks, until each source has one, which is rounded by itself.
So a source ends within one document of its target, usually a short one.
A hot source has more chunks, not larger ones. Built-in functions only.

Everything is drawn from hashes of (doc_id, source, text), so reruns agree,
whatever the partitions.

Defined results: a null text has no words; documents without words get the
whole copies only. A null source is a source of its own, the last in order; a
null id is an id. Rows that are equal in id, source and text are told apart by a
number, and any of them may get the copy. Very long texts are documents of
their size. Ties in size are ordered by hash. Sources without words have the
target 0; no rows: no result. Other columns are not read by plan(), and mixed()
carries them whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut

#: Documents of a chunk, about.
FAN = 64

#: Parts of a word that move between documents are multiples of 2^-UNIT.
UNIT = 20

#: Rows up to which the table of sources is broadcast; above it documents are salted.
BROADCAST_SOURCES = 100_000
SALTS = 64

_KEYS = ("doc_id", "source", "__mark")


def _running(df: DataFrame, order: Sequence[Column], **sums: str) -> DataFrame:
    """df with __rank (rows before a row in the order) and, for name=column, the sum of the column over those rows."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__at": F.monotonically_increasing_id(), "__task": F.spark_partition_id()}))
    # a row for each task of the sort, whatever the number of rows
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"), *[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    zero = lambda c: F.coalesce(c, F.lit(0))
    tasks = tasks.select("__task", "__first", zero(F.sum("__n").over(before)).alias("__rank"), *[zero(F.sum(f"__{name}").over(before)).alias(f"__{name}") for name in sums])
    within = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(tasks), "__task").withColumn("__rank", F.col("__rank") + F.col("__at") - F.col("__first"))
    out = out.withColumns({name: F.col(f"__{name}") + zero(F.sum(c).over(within)) for name, c in sums.items()})
    return out.drop("__at", "__task", "__first", *[f"__{name}" for name in sums])


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and n of each source (given), with its target.

    The sources, ordered by code point with null last, have the weights in
    turn. Together they get `share` of all words by weight, each at most `most`
    times its own; what is over goes to the others by weight, until none is over.
    """
    order = _running(sources, [F.col("source").asc_nulls_last()])
    weighed = order.withColumn("__w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights)).cast("int"))).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    weighed = weighed.drop("__rank")
    # sources fill in the order of cap over weight; the first that doesn't fill sets the words for a unit of weight
    filled = _running(weighed, [F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()], caps="__cap", before="__w")
    whole = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("__w"), F.lit(0.0)).alias("weight")).first()
    level = (F.lit(float(whole["words"])) * share - F.col("caps")) / (F.lit(whole["weight"]) - F.col("before"))
    unit = filled.where(level * F.col("__w") <= F.col("__cap")).agg(F.min_by(level, F.col("__rank")).alias("unit")).first()["unit"]
    target = F.col("__cap") if unit is None else F.least(F.col("__cap"), F.lit(float(unit)) * F.col("__w"))
    return filled.select("source", "source_size", "n", target.cast("double").alias("target"))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEYS).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (written, with __at and __task) with __nth, a number among those with equal keys: within each task, after the tasks before it."""
    nth = F.row_number().over(Window.partitionBy(*_KEYS, "__task").orderBy("__at")) - 1
    counts = rows.groupBy(*_KEYS, "__task").agg(F.count("*").alias("__c"))
    # a row for each task that holds the key
    before = Window.partitionBy(*_KEYS).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    some = rows.withColumn("__nth", nth)
    return some.join(counts, _same(some, counts, *_KEYS, "__task")).select(*[some[c] for c in rows.columns], (F.col("__nth") + F.col("__before")).alias("__nth"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows with __nth and __again (its keys occur more than once)."""
    repeated = _repeated(rows)
    once = rows.withColumns({"__nth": F.lit(0).cast("long"), "__again": F.lit(False)})
    if repeated.isEmpty():
        return once
    repeated = cut(repeated)
    on = _same(rows, repeated, *_KEYS)
    again = _numbered(cut(rows.join(repeated, on, "left_semi"))).withColumn("__again", F.lit(True))
    single = rows.join(repeated, on, "left_anti").withColumns({"__nth": F.lit(0).cast("long"), "__again": F.lit(False)})
    return single.unionByName(again)


def _marked(documents: DataFrame) -> DataFrame:
    return documents.withColumn("__mark", F.xxhash64("text", F.lit(0)))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _moved(held: Column, x: Column, level: int) -> Column:
    """What two fractional documents are after words have moved between them."""
    room = lambda d: F.shiftleft(d["size"], UNIT) - d["mass"]
    both = F.struct(F.least(room(held), x["mass"]).alias("up"), F.least(held["mass"], room(x)).alias("down"))

    def drawn(b: Column) -> Column:
        draw = F.pmod(F.xxhash64(held["__u"], x["__u"], F.lit(level)), b["up"] + b["down"])
        gain = F.when(draw < b["down"], b["up"]).otherwise(-b["down"])
        end = lambda d, mass: F.struct(d["__u"].alias("__u"), d["doc_id"].alias("doc_id"), d["__key"].alias("__key"), d["size"].alias("size"), mass.alias("mass"))
        return _let(gain, lambda g: F.array(end(held, held["mass"] + g), end(x, x["mass"] - g)))

    return _let(both, drawn)


def _folded(units: Column, unit: str, level: int) -> Column:
    """struct(held, done) of an array of fractional documents: the one that stays fractional, or null, and those that don't."""
    whole = lambda d: (d["mass"] == 0) | (d["mass"] == F.shiftleft(d["size"], UNIT))
    start = F.struct(F.lit(None).cast(unit).alias("held"), F.array().cast(f"array<{unit}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        first = F.struct(x.alias("held"), acc["done"].alias("done"))
        paired = _let(_moved(acc["held"], x, level), lambda two: F.struct(F.get(F.filter(two, lambda d: ~whole(d)), F.lit(0)).alias("held"), F.concat(acc["done"], F.filter(two, whole)).alias("done")))
        return F.when(acc["held"].isNull(), first).otherwise(paired)

    return F.aggregate(units, start, step)


def _copies(documents: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """doc_id, source, __mark, __nth, __again, size, source_size, target and copies of each row."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = cut(_marked(documents.select("doc_id", "source", "text")).select(*_KEYS, words.alias("size"), F.monotonically_increasing_id().alias("__at"), F.spark_partition_id().alias("__task")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = cut(targets(by_source, weights, share, most))
    named = _told_apart(rows).drop("__at", "__task").withColumn("__u", F.xxhash64(*_KEYS, "__nth"))

    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    salts = 1 if few else SALTS
    salted = sources.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    named = named.withColumn("__salt", F.pmod("__u", F.lit(salts)).cast("int"))
    joined = named.join(F.broadcast(salted) if few else salted, _same(named, salted, "source", "__salt")).select(*[named[c] for c in named.columns if c != "__salt"], "source_size", "n", "target")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("__rate", rate).withColumn("whole", F.floor("__rate"))
    mass = F.floor((F.col("__rate") - F.col("whole")) * F.shiftleft("size", UNIT) + 0.5)
    wide = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN))
    key = F.struct("__mark", "__nth", "__again").alias("__key")
    units = joined.select("source", "source_size", "target", "whole", wide.alias("width"), "__u", "doc_id", key, "size", mass.alias("mass"))

    group = ["source", "source_size", "target", "whole"]
    kind = units.schema
    unit = "struct<" + ", ".join(f"{c}: {kind[c].dataType.simpleString()}" for c in ("__u", "doc_id", "__key", "size", "mass")) + ">"
    full = F.shiftleft("size", UNIT)
    fractional = (F.col("mass") > 0) & (F.col("mass") < full)
    ended = lambda df, extra: df.select(*group, "doc_id", "__key", "size", (F.col("whole") + extra).alias("copies"))
    by_itself = ((F.col("size") > 0) & (F.col("mass") == full)).cast("long")
    parts = [ended(units.where(~fractional), by_itself)]
    left, width = units.where(fractional), sources.agg(F.max("n")).first()[0] or 0
    width, level = max(1, -(-width // FAN)), 0
    while True:
        chunk = F.pmod(F.xxhash64("__u", F.lit(level)), "width")
        gathered = left.groupBy(*group, "width", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "__u", "doc_id", "__key", "size", "mass"))).alias("units"))
        folded = cut(gathered.select(*group, "width", _folded(F.transform("units", lambda x: F.struct(*[x[c].alias(c) for c in ("__u", "doc_id", "__key", "size", "mass")])), unit, level).alias("f")))
        parts.append(ended(folded.select(*group, F.explode("f.done").alias("d")).select(*group, "d.*"), by_itself))
        left = folded.where("f.held IS NOT NULL").select(*group, F.ceil(F.col("width") / FAN).alias("width"), "f.held.*")
        if width == 1:
            break
        width, level = -(-width // FAN), level + 1
    parts.append(ended(left, (F.pmod(F.xxhash64("__u", F.lit(-1)), full) < F.col("mass")).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "source", "__key.*", "size", "source_size", "target", "copies")


def plan(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of each row of documents (doc_id, source, text)."""
    rows = _copies(documents, weights, share, most)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix: the rows of documents with all their columns, each as often as plan() says."""
    names = documents.columns
    copies = cut(_copies(documents, weights, share, most).where("copies > 0").withColumnsRenamed({c: f"__c_{c}" for c in ("doc_id", "source", "__mark", "__nth")}))
    docs = _marked(documents)

    def taken(rows: DataFrame, those: DataFrame, *keys: str) -> DataFrame:
        on = F.lit(True)
        for c in keys:
            on = on & rows[c].eqNullSafe(those[f"__c_{c}"])
        return rows.join(those, on).select(*[rows[c] for c in names], F.explode(F.array_repeat(F.lit(1), those["copies"].cast("int"))).alias("__one")).drop("__one")

    once = taken(docs, copies.where("not __again"), *_KEYS)
    some = copies.where("__again")
    if some.isEmpty():
        return once
    keys = some.select(*[F.col(f"__c_{c}").alias(c) for c in _KEYS]).distinct()
    again = cut(docs.join(keys, _same(docs, keys, *_KEYS), "left_semi").withColumns({"__at": F.monotonically_increasing_id(), "__task": F.spark_partition_id()}))
    return once.unionByName(taken(_numbered(again), some, *_KEYS, "__nth"))
