"""A stored BM25 index: postings, term statistics and lengths as tables, searched without reading any text.

Under a path lie
  postings  keys, term, chunk_id, tf, dl, batch; sorted by term over all tasks,
            so that a common term is split among files and a rare one lies in
            few row groups;
  terms     keys, term, class, df, max_tf, min_dl; what each batch adds to a
            term's postings of a class (those with 1, 2-3, 4-7, ... occurrences);
  lengths   keys, n, tokens; what each batch adds to a collection;
  gone      chunk_id, batch; chunks that a batch has taken out.

search() gives the rows of retrieval.bm25 by MaxScore. No posting of a class can
add more than its term's idf with max_tf and min_dl (this bound holds for any
mean length, so it stays valid as the index grows), and no posting of a term
more than its best class. A question's terms are ordered by that bound. The
scores of its few rarest postings set a floor: the k-th best is at least that.
Terms at the end of the order whose bounds together stay under the floor can't
lift a chunk over it alone, so only chunks of the other terms are candidates.
The whole scores of the best of those raise the floor; candidates that can't
reach it even with the rest are dropped, and only the remaining ones look their
common terms up. So a common term's postings are never multiplied by the
questions that have it. Where all postings of all questions are few (their
number is known from the terms), they are summed up as they are: the rows are
the same, and the steps above would cost more than they save.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import coarse_tokens
from .retrieval import BROADCAST_ROWS, question_terms, small, top
from .shared import written

#: Scores are compared with this much room, because sums are not rounded before the end.
EPS = 1e-6

#: For each row that is wanted: postings of a question's first terms that set the floor, and best candidates that raise it.
SEEDS = 20
FIRST = 3

#: Postings of all questions that are summed up without pruning.
DIRECT = 1 << 25

#: Rows of (question, chunk, term) up to which they are broadcast to the postings.
LOOKUPS = 500_000


@dataclass(frozen=True)
class TextIndex:
    """A written index; keys split it into collections with statistics of their own."""

    path: str
    keys: tuple[str, ...]
    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    batch: int


def _postings(corpus: DataFrame, keys: Sequence[str]) -> DataFrame:
    tokens = corpus.select(*keys, "chunk_id", coarse_tokens(F.col("content")).alias("tokens"))
    return tokens.select(*keys, "chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy(*keys, "chunk_id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))


def _append(corpus: DataFrame, path: str, keys: Sequence[str], batch: int) -> None:
    spark = corpus.sparkSession
    rows = _postings(corpus, keys).withColumn("batch", F.lit(batch))
    rows.repartitionByRange("term", F.xxhash64("chunk_id")).sortWithinPartitions("term").write.mode("append").parquet(f"{path}/postings/batch={batch}/")
    mine = spark.read.schema(rows.schema).parquet(f"{path}/postings/batch={batch}/")
    _add_terms(mine, path, keys, 1)
    _add_lengths(corpus.select(*keys, F.size(coarse_tokens(F.col("content"))).alias("dl")), path, keys, 1)


def _add_terms(postings: DataFrame, path: str, keys: Sequence[str], sign: int) -> None:
    found = postings.groupBy(*keys, "term", F.floor(F.log2("tf")).cast("int").alias("class")).agg((sign * F.count("*")).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    found.write.mode("append").parquet(f"{path}/terms")


def _add_lengths(chunks: DataFrame, path: str, keys: Sequence[str], sign: int) -> None:
    found = chunks.groupBy(*keys).agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).cast("long").alias("tokens"))
    found.write.mode("append").parquet(f"{path}/lengths")


def build(corpus: DataFrame, path: str, keys: Sequence[str] = ()) -> TextIndex:
    """Index a corpus (chunk_id, content, keys) under path."""
    spark = corpus.sparkSession
    kind = corpus.schema["chunk_id"].dataType.simpleString()
    _append(corpus, path, keys, 0)
    spark.createDataFrame([], f"chunk_id {kind}, gone_in int").write.parquet(f"{path}/gone")
    return load(spark, path, keys)


def load(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> TextIndex:
    postings, gone = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/gone")
    newest = max(postings.agg(F.max("batch")).first()[0] or 0, gone.agg(F.max("gone_in")).first()[0] or 0)
    if not gone.isEmpty():
        last = gone.groupBy("chunk_id").agg(F.max("gone_in").alias("gone_in"))
        there = postings.join(small(last.withColumnRenamed("chunk_id", "__chunk")), (F.col("chunk_id") == F.col("__chunk")) & (F.col("batch") < F.col("gone_in")), "left_anti")
    else:
        there = postings
    terms = spark.read.parquet(f"{path}/terms")
    lengths = spark.read.parquet(f"{path}/lengths").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    return TextIndex(path, tuple(keys), there, terms, lengths, newest)


def add(index: TextIndex, corpus: DataFrame) -> TextIndex:
    """The index with further chunks; only their texts are read."""
    _append(corpus, index.path, index.keys, index.batch + 1)
    return load(corpus.sparkSession, index.path, index.keys)


def remove(index: TextIndex, chunks: DataFrame) -> TextIndex:
    """The index without some chunks (chunk_id, and keys and content for their statistics, as they were added)."""
    batch = index.batch + 1
    ids = chunks.select("chunk_id").distinct()
    _add_terms(index.postings.join(small(ids), "chunk_id", "left_semi"), index.path, index.keys, -1)
    _add_lengths(chunks.select(*index.keys, F.size(coarse_tokens(F.col("content"))).alias("dl")), index.path, index.keys, -1)
    ids.withColumn("gone_in", F.lit(batch)).write.mode("append").parquet(f"{index.path}/gone")
    return load(chunks.sparkSession, index.path, index.keys)


def _share(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return F.col("idf") * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * F.greatest(dl, F.lit(1)) / F.greatest(F.col("avg_dl"), F.lit(1e-6))))


def search(index: TextIndex, questions: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, keys, chunk_id, bm25_raw, bm25_score (over the question's best), rank: the rows of retrieval.bm25."""
    keys = list(index.keys)
    each = ["qid", *keys]
    terms = written(question_terms(questions))
    few = small if terms.count() * max(1, index.lengths.count()) > BROADCAST_ROWS else F.broadcast
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lengths = index.lengths.withColumn("avg_dl", F.col("tokens") / F.col("n"))
    classes = index.terms.join(few(terms.select("term").distinct()), "term").groupBy(*keys, "term", "class").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).where("df > 0")
    classes = classes.join(few(lengths), keys) if keys else classes.crossJoin(F.broadcast(lengths))  # one row of lengths
    share = _share(F.col("max_tf"), F.col("min_dl"), k1, b)
    found = classes.withColumn("idf", F.lit(1.0)).groupBy(*keys, "term", "n", "avg_dl").agg(F.sum("df").alias("df"), F.max(share).alias("share"))
    found = found.withColumn("idf", idf).withColumn("bound", F.col("idf") * F.col("share")).join(few(terms), "term")
    order = Window.partitionBy(*each).orderBy(F.col("bound").desc(), "term")
    found = found.withColumns({"rest": F.sum("bound").over(order.rowsBetween(0, Window.unboundedFollowing)), "before": F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    asked = written(found.select(*each, "term", "df", "idf", "avg_dl", "bound", "rest", "before"))  # a row for each question's term
    part = _share(F.col("tf"), F.col("dl"), k1, b)

    def summed(some: DataFrame) -> DataFrame:
        return index.postings.join(few(some), [*keys, "term"]).groupBy(*each, "chunk_id").agg(F.sum(part).alias("part"))

    def best_of(scores: DataFrame, n: int) -> DataFrame:
        w = Window.partitionBy(*each).orderBy(F.col("part").desc())
        return scores.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)

    def looked_up(rows: DataFrame, some: DataFrame) -> DataFrame:
        """What some terms add to rows (qid, keys, chunk_id)."""
        wanted = rows.select(*each, "chunk_id").join(few(some), each)
        return index.postings.join(small(wanted, LOOKUPS), [*keys, "term", "chunk_id"]).groupBy(*each, "chunk_id").agg(F.sum(part).alias("part"))

    if (asked.agg(F.sum("df")).first()[0] or 0) <= DIRECT:
        return _ranked(summed(asked), each, k)
    floors = best_of(summed(asked.where(F.col("before") < SEEDS * k)), k).where(F.col("__n") == k).select(*each, F.col("part").alias("floor"))
    asked = written(asked.join(few(floors), each, "left").withColumn("needed", F.coalesce(F.col("rest") >= F.col("floor") - EPS, F.lit(True))))
    common = asked.where("not needed").select(*each, "term", "idf", "avg_dl")
    left = asked.groupBy(*each).agg(F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("left"))
    found = written(summed(asked.where("needed")))
    first = written(best_of(found, FIRST * k).drop("__n"))
    whole = first.unionByName(looked_up(first, common)).groupBy(*each, "chunk_id").agg(F.sum("part").alias("part"))
    raised = best_of(whole, k).where(F.col("__n") == k).select(*each, F.col("part").alias("floor"))
    hopeful = found.join(few(left), each).join(few(raised), each, "left")
    hopeful = written(hopeful.where(F.col("part") + F.col("left") >= F.coalesce(F.col("floor"), F.lit(0.0)) - EPS).select(*each, "chunk_id", "part"))
    more = looked_up(hopeful, common)
    return _ranked(hopeful.unionByName(more).groupBy(*each, "chunk_id").agg(F.sum("part").alias("part")), each, k)


def _ranked(sums: DataFrame, each: Sequence[str], k: int) -> DataFrame:
    scored = sums.select(*each, "chunk_id", F.round("part", 8).alias("bm25_raw")).where("bm25_raw > 0")
    best = top(scored, k, F.col("bm25_raw"), *each)
    most = F.max("bm25_raw").over(Window.partitionBy(*each))
    return best.select(*each, "chunk_id", "bm25_raw", F.round(F.col("bm25_raw") / most, 8).alias("bm25_score"), "rank")
