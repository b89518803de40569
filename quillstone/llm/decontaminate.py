"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters, digits and points or commas between digits.
Numbers (digits or number words), units of measure and names (capitalised
words after another word or a comma, so not at the beginning of a sentence;
a name of several words is one token) become typed placeholders, other tokens
are in lower case. Windows of tokens of both sides are hashed and joined, so a
question with other numbers or names still matches its template. On each
stretch of consecutive windows of a diagonal (one alignment of document and
item) the slots are then compared. A value of the item (a number with its
unit) should stand for one value of the document: a slot that has neither the
item's own value nor that of most slots of its value conflicts, and the windows
that hold it are dropped, no others. A document is contaminated by an item if
the windows left are `run - window + 1` or more different windows of the item,
or half of its windows. An item without a usable window (short, or of too few
literal tokens) contaminates the documents that hold all of its tokens in a row,
with equal values. DataFrame functions only: no Python runs on executors.

Only rows of documents that match a window are shuffled; the documents' own
windows are streamed past the benchmark's. Those are one row for each distinct
window, with the places that hold it, and are broadcast if there are at most
BROADCAST_WINDOWS of them and shuffled otherwise, as are all other tables of
the benchmark.

Defined results: null and empty texts have no window. Items without a token, or
with a null id or text, are never found; items that repeat are one where their
texts are equal, else each text counts for the id. An item of one word is found
in each document with that word. Rows of documents are checked one by one, by
id and text: a null doc_id is a value like others for without_benchmark, and
contaminated() doesn't report it; rows that repeat a doc_id with other texts
are judged apart, and reported once. Very long texts are checked whole. Empty
tables give no pair. Other columns are only carried, whatever their names. A
window with fewer than `literals` tokens that are no placeholder is too general
and is left out; so is its item's template, if it has no other window, but not
its wording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut

#: Units of measure and currencies.
UNITS = ("km", "cm", "mm", "kg", "mg", "ml", "lb", "lbs", "oz", "ft", "mi", "mph", "kmh", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "mile", "miles", "meter", "meters", "metre", "metres", "feet", "inch", "inches", "pound", "pounds", "gram", "grams", "litre", "litres", "liter", "liters")
#: Marks of the placeholders, before the token that they stand for.
NUMBER, NAME, UNIT = "\x01n", "\x01p", "\x01u"
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
#: Joins the words of a name.
JOINT = "\x02"
#: Rows up to which a table made from the benchmark is broadcast (under 100 bytes each).
BROADCAST_WINDOWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast, if the rows are few enough (a table that is read again for the count)."""
    return F.broadcast(df) if df.count() <= BROADCAST_WINDOWS else df


def tokens(text: Column) -> Column:
    """Tokens in lower case; numbers and names with their marks."""
    text = F.regexp_replace(text, "[\x01\x02]", " ")
    # possessive: Java's regex goes a level deeper into the stack for each word of a name otherwise, until that overflows and the executor ends
    text = F.regexp_replace(text, "(?<=[\\p{L}\\p{N},;)] )\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)*+", NAME + "$0")
    text = F.regexp_replace(text, "(?<=\\p{Ll}) (?=\\p{Lu}\\p{Ll})", JOINT)
    text = F.regexp_replace(text, "(?<![\\p{L}\\p{N}.,])[0-9]", NUMBER + "$0")
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}\x01\x02.,]+|[.,](?![0-9])[^\\p{L}\\p{N}\x01]*"), lambda t: t != "")


def kind(token: Column) -> Column:
    """What stands for the token in a window."""
    return F.when(token.startswith("\x01"), F.substring(token, 1, 2)).when(token.isin(*UNITS), UNIT).when(token.isin(*NUMBER_WORDS), NUMBER).otherwise(token)


def _windows(kinds: str, n: int) -> Column:
    """The hash of the n kinds from each place on."""
    places = F.when(F.size(kinds) >= n, F.sequence(F.lit(1), F.size(kinds) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(kinds, i, F.lit(n))))


def _literal(tokens: str | Column) -> Column:
    """The words as they stand: a name's mark depends on what is before it."""
    return F.flatten(F.transform(tokens, lambda t: F.split(F.when(t.startswith("\x01"), F.substring(t, 3, 1 << 30)).otherwise(t), JOINT)))


def _placed(windows: DataFrame, *keys: str) -> DataFrame:
    """One row for each distinct key, with the places that hold it; so a hot key of the documents meets one row."""
    places = F.collect_list(F.struct(*[c for c in windows.columns if c not in keys])).alias("places")
    return cut(windows.groupBy(*keys).agg(places))


def _verbatim(docs: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """doc, tag, item_id, n_windows, item_windows of items that documents hold token by token; None without items.

    An item of fewer tokens than a window is one window of its own length; of
    a longer one, all windows must be on a diagonal.
    """
    width = F.least(F.size("literal"), F.lit(window))
    items = items.select("item_id", _literal("tokens").alias("literal")).distinct().withColumn("width", width)
    at = F.transform(F.sequence(F.lit(1), F.size("literal") - F.col("width") + 1), lambda i: F.xxhash64(F.slice("literal", i, F.col("width"))))
    keyed = items.select("item_id", F.xxhash64("literal").alias("item_tag"), "width", (F.size("literal") - F.col("width") + 1).alias("item_windows"), F.posexplode(at).alias("item_at", "hash"))
    keyed = _placed(keyed, "width", "hash")
    # at most `window` widths
    widths = sorted(r["width"] for r in keyed.select("width").distinct().collect())
    if not widths:
        return None
    literal = docs.select("doc", "tag", _literal(tokens(F.col("text"))).alias("literal"))
    placed = lambda n: F.transform(_windows("literal", n), lambda h, i: F.struct(F.lit(n).alias("width"), i.alias("at"), h.alias("hash")))
    each = [placed(n) for n in widths]
    own = literal.select("doc", "tag", F.explode(F.concat(*each)).alias("w")).select("doc", "tag", "w.*")
    found = own.join(_small(keyed), ["width", "hash"]).select("doc", "tag", "at", F.explode("places").alias("p")).select("doc", "tag", "p.*", (F.col("at") - F.col("p.item_at")).alias("diagonal"))
    counted = found.groupBy("doc", "tag", "item_id", "item_tag", "item_windows", "diagonal").agg(F.count_distinct("item_at").alias("n_windows"))
    whole = counted.where("n_windows = item_windows")
    return whole.select("doc", "tag", "item_id", F.col("n_windows").cast("long"), F.col("item_windows").cast("long"))


def _keys(items: DataFrame) -> DataFrame:
    """item_id, slot, item_value and key: what must stand for one value, so 5 dollars and 5 days are two."""
    unit = lambda i: F.when(F.get("tokens", i + 1).isin(*UNITS), F.concat(F.lit(" "), F.get("tokens", i + 1))).otherwise("")
    keys = F.transform("tokens", lambda t, i: F.struct(t.alias("item_value"), F.when(kind(t) == NUMBER, F.concat(t, unit(i))).otherwise(t).alias("key")))
    out = items.select("item_id", F.posexplode(keys).alias("slot", "x")).select("item_id", "slot", "x.item_value", "x.key")
    return out.where(kind(F.col("item_value")).startswith("\x01")).distinct()


def _slots(df: DataFrame, place: str, value: str, *keys: str) -> DataFrame:
    """The places and values of placeholders in the column tokens."""
    out = df.select(*keys, F.posexplode("tokens").alias(place, value))
    return out.where(kind(F.col(value)).startswith("\x01"))


#: Stands for a null doc_id.
NO_ID = "\x00"


def _row(documents: DataFrame) -> list[Column]:
    """What tells rows apart: the id as text, and the text's hash."""
    return [F.coalesce(documents["doc_id"].cast("string"), F.lit(NO_ID)), F.xxhash64(documents["text"])]


def _pairs(documents: DataFrame, benchmark: DataFrame, window: int = 8, run: int = 13, literals: int = 4) -> DataFrame:
    """doc, tag (see _row), item_id, n_windows, item_windows of contaminated rows."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where("item_id is not null")
    items = items.withColumn("kinds", F.transform("tokens", kind)).distinct()
    all_windows = items.select("item_id", "kinds", F.posexplode(_windows("kinds", window)).alias("item_at", "hash"))
    plain = F.size(F.filter(F.slice("kinds", F.col("item_at") + 1, window), lambda k: ~k.startswith("\x01")))
    windows = cut(all_windows.where(plain >= literals).select("item_id", "item_at", "hash"))
    sizes = windows.groupBy("item_id").agg(F.count_distinct("item_at").alias("item_windows"))

    usable = F.exists(F.sequence(F.lit(1), F.size("kinds") - (window - 1)), lambda i: F.size(F.filter(F.slice("kinds", i, F.lit(window)), lambda k: ~k.startswith("\x01"))) >= literals)
    rest = items.where("size(tokens) > 0").where(~F.when(F.size("kinds") >= window, usable).otherwise(F.lit(False)))

    doc, tag = _row(documents)
    docs = documents.where(documents["text"].isNotNull()).select(doc.alias("doc"), tag.alias("tag"), "text")
    kinds = docs.select("doc", "tag", F.transform(tokens(F.col("text")), kind).alias("kinds"))
    own = kinds.select("doc", "tag", F.posexplode(_windows("kinds", window)).alias("at", "hash"))
    placed = own.join(_small(_placed(windows, "hash")), "hash").select("doc", "tag", "at", F.explode("places").alias("p"))
    found = cut(placed.select("doc", "tag", "p.item_id", "p.item_at", (F.col("at") - F.col("p.item_at")).alias("diagonal")))

    # slots of the items in the windows found, and what stands for them in the documents
    alignment = ["doc", "tag", "item_id", "diagonal"]
    item_slots = _keys(items)
    found = found.distinct().withColumn("stretch", F.col("item_at") - F.row_number().over(Window.partitionBy(*alignment).orderBy("item_at")))
    covered = found.join(_small(item_slots), (found["item_id"] == item_slots["item_id"]) & F.col("slot").between(F.col("item_at"), F.col("item_at") + (window - 1))).select("doc", "tag", found["item_id"], "diagonal", "stretch", "slot", "item_value", "key").distinct()
    covered = cut(covered)
    left = found
    if not covered.isEmpty():
        rows = covered.select("doc", "tag").distinct()
        texts = cut(docs.join(_small(rows), ["doc", "tag"], "left_semi"))
        values = _slots(texts.select("doc", "tag", tokens(F.col("text")).alias("tokens")), "place", "value", "doc", "tag").distinct()
        compared = covered.withColumn("place", (F.col("slot") + F.col("diagonal")).cast("int")).join(values, ["doc", "tag", "place"])
        stretch = [*alignment, "stretch"]
        same, all_slots = (F.count("*").over(Window.partitionBy(*stretch, "key", *more)) for more in (["value"], []))
        torn = compared.withColumns({"same": same, "slots": all_slots}).where("value <> item_value and 2 * same <= slots").select(*stretch, F.col("slot").alias("torn"))
        on = [F.col(f"found.{c}") == F.col(f"torn.{c}") for c in stretch]
        left = found.alias("found").join(torn.alias("torn"), [*on, F.col("torn.torn").between(F.col("item_at"), F.col("item_at") + (window - 1))], "left_anti")

    counted = left.groupBy("doc", "tag", "item_id").agg(F.count_distinct("item_at").alias("n_windows")).join(_small(sizes), "item_id")
    enough = F.least(F.lit(run - window + 1), F.ceil(F.col("item_windows") / 2))
    pairs = counted.where(F.col("n_windows") >= enough).select("doc", "tag", "item_id", "n_windows", "item_windows")
    verbatim = _verbatim(docs, rest, window)
    return pairs if verbatim is None else pairs.unionByName(verbatim)


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 8, run: int = 13, literals: int = 4) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, found in the document), item_windows: a row for each contaminated pair.

    documents: doc_id, text; benchmark: item_id, text.
    """
    pairs = _pairs(documents, benchmark, window, run, literals).where(F.col("doc") != NO_ID)
    doc = F.col("doc").cast(documents.schema["doc_id"].dataType).alias("doc_id")
    return pairs.groupBy("doc", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows")).select(doc, "item_id", "n_windows", "item_windows")


def without_benchmark(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of documents that no item contaminates, with all their columns."""
    gone = cut(_pairs(documents, benchmark, **options).select("doc", "tag").distinct())
    doc, tag = _row(documents)
    return documents.join(_small(gone), (doc == gone["doc"]) & (tag == gone["tag"]), "left_anti")
