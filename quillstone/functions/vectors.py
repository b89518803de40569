"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clip01


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def fitted(a: Column, size: int) -> Column:
    """Padded with zeros or cut to the size, then scaled to unit length; zero vectors stay."""
    padded = F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size)), 1, size)
    return F.transform(padded, lambda x: x / F.when(norm(padded) > 0, norm(padded)).otherwise(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero, clipped to [0, 1]."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, clip01(dot(a, b) / scale)).otherwise(F.lit(0.0))


def hash_embedding(texts: DataFrame, key: str, tokens: Column, dim: int = 1024) -> DataFrame:
    """(key, bucket, weight) of the non-zero places of a text's hash vector, scaled to unit length.

    A token adds 1 or -1, by a further bit of its SHA-256, at the place that
    its last bits name. Sparse rows, so that the size follows the tokens.
    """
    tail = lambda t: F.conv(F.substring(F.sha2(t, 256), 62, 3), 16, 10).cast("int")
    rows = texts.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    rows = rows.select(key, (tail(F.col("token")) % dim).alias("bucket"), F.when(tail(F.col("token")).bitwiseAND(256) == 0, F.col("n")).otherwise(-F.col("n")).alias("v"))
    cells = rows.groupBy(key, "bucket").agg(F.sum("v").alias("v")).where("v <> 0")
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("norm"))
    return cells.join(norms, key).select(key, "bucket", (F.col("v") / F.col("norm")).alias("weight"))


def placed_hash_embedding(texts: DataFrame, key: str, text: Column, dim: int = 1024) -> DataFrame:
    """(key, bucket, weight) of the non-zero places of the text's hash vector by place, scaled to unit length.

    A token's SHA-256 with its place modulo 23 names its bucket (first four
    bytes), sign (the fifth) and size (the sixth); the 32 bytes of the whole
    text's digest add a little each. Blank texts have no rows.
    """
    from .text import char_tokens, normalize_whitespace

    byte = lambda digest, i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    rows = texts.select(key, normalize_whitespace(text, False).alias("t")).where("t <> ''")
    tokens = rows.select(key, F.posexplode(char_tokens(F.col("t"))).alias("at", "token")).select(key, F.sha2(F.concat_ws("|", "token", F.col("at") % 23), 256).alias("d"))
    sign = F.when(byte(F.col("d"), 4) % 2 == 0, 1.0).otherwise(-1.0)
    own = tokens.select(key, (F.conv(F.substring("d", 1, 8), 16, 10).cast("long") % dim).cast("int").alias("bucket"), (sign * (0.5 + byte(F.col("d"), 5) / 255.0)).alias("v"))
    whole = rows.select(key, F.sha2("t", 256).alias("d")).select(key, "d", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    share = F.conv(F.substring(F.col("d"), 2 * F.col("i") + 1, F.lit(2)), 16, 10).cast("int")
    little = whole.select(key, ((F.col("i") * 67 + share) % dim).cast("int").alias("bucket"), ((share / 255.0 - 0.5) * 0.1).alias("v"))
    cells = own.unionByName(little).groupBy(key, "bucket").agg(F.sum("v").alias("v")).where("v <> 0")
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).where("norm > 0")
    return cells.join(norms, key).select(key, "bucket", (F.col("v") / F.col("norm")).alias("weight"))
