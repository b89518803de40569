"""Reranking of candidates (qid, chunk_id, scores, texts) of many questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip01, coarse_tokens, exact_key, near_duplicate_score, token_overlap
from .candidates import pair_text, recall_score


def min_max(score: str, *keys: str) -> Column:
    """Scores of a question brought to [0, 1]: not positive ones are 0, equal positive ones 1."""
    w = Window.partitionBy(*keys)
    low, high, x = F.min(score).over(w), F.max(score).over(w), F.col(score)
    return F.when((high <= 0) | (x <= 0), 0.0).when(low == high, 1.0).otherwise(clip01((x - low) / (high - low)))


def relative(score: str, *keys: str) -> Column:
    """As min_max, but equal scores are 1 whatever their sign."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(low == high, 1.0).otherwise(clip01((F.col(score) - low) / (high - low)))


def metadata_boost(question: Column, heading: Column, titles: list[Column], source: Column, page: Column, hint: Column) -> Column:
    tokens = coarse_tokens(question)
    score = 0.35 * token_overlap(tokens, coarse_tokens(heading)) + 0.20 * token_overlap(tokens, coarse_tokens(source))
    for t in titles:
        score = score + 0.15 * token_overlap(tokens, coarse_tokens(t))
    return clip01(score + F.when(F.abs(page - hint) <= 1, 0.20).otherwise(0.0))


def table_boost(question: Column, query_type: Column, chunk_type: Column, header: Column, context: Column) -> Column:
    tokens = coarse_tokens(question)
    score = F.when(F.lower(chunk_type) == "table", 0.60).otherwise(0.0) + 0.25 * token_overlap(tokens, coarse_tokens(header)) + 0.15 * token_overlap(tokens, coarse_tokens(context))
    return F.when(query_type == "table_qa", clip01(score)).otherwise(0.0)


def deduplicated(candidates: DataFrame, score: str = "retrieval_score", text: str = "content", threshold: float = 0.9, pool: int = 160) -> DataFrame:
    """qid, chunk_id, place of what a greedy pass in the order of the score keeps.

    A candidate goes if its text without marks was seen, or if its tokens are
    near those of one kept before it. The pass is a fold over one question's
    `pool` best rows (a retrieval pool, so the group is bounded); rows behind
    them are kept as they are, for the caller to cut.
    """
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), "chunk_id")
    rows = candidates.select("qid", "chunk_id", F.row_number().over(w).alias("place"), exact_key(F.col(text)).alias("key"), F.array_distinct(coarse_tokens(F.col(text))).alias("tokens"))
    behind = rows.where(F.col("place") > pool).select("qid", "chunk_id", "place")
    rows = rows.where(F.col("place") <= pool)
    item = F.struct("place", "chunk_id", "key", "tokens")
    gathered = rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept: Column, x: Column) -> Column:
        seen = F.exists(kept, lambda y: ((x["key"] != "") & (y["key"] == x["key"])) | (near_duplicate_score(x["tokens"], y["tokens"]) >= threshold))
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), F.slice("items", 1, 1), step)
    return gathered.select("qid", F.explode(kept).alias("x")).select("qid", "x.chunk_id", "x.place").unionByName(behind)


def neighbours(seeds: DataFrame, ranked: DataFrame, score: str = "retrieval_score") -> DataFrame:
    """qid, seed, chunk_id, score: each seed's best chunk of the same document and page one place before or after it, if not a seed itself; its score rises by 0.02."""
    s = seeds.select("qid", F.col("chunk_id").alias("seed"), "doc_id", "page_idx", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index"), F.col("chunk_index") + 1)).alias("chunk_index"))
    others = ranked.join(seeds.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    near = s.join(others, ["qid", "doc_id", "page_idx", "chunk_index"])
    w = Window.partitionBy("qid", "seed").orderBy(F.col(score).desc(), "chunk_id")
    return near.withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", "seed", "chunk_id", F.round(clip01(F.col(score) + 0.02), 8).alias("score"))


def supplemented(seeds: DataFrame, ranked: DataFrame, k: int, score: str = "retrieval_score") -> DataFrame:
    """qid, chunk_id, seed, score: the seeds (seed is null) and the neighbours that they bring in, one after the other in the order of their score.

    A seed brings the best of ranked that is in its document and on its page,
    at most one place away, and not chosen yet; its score rises by 0.02. That
    ends when max(2 k, k + 2) chunks are chosen. The fold is over one
    question's seeds and those near them.
    """
    most = max(2 * max(1, k), max(1, k) + 2)
    by = Window.partitionBy("qid").orderBy(F.col(score).desc(), "chunk_id")
    numbered = seeds.withColumn("__n", F.row_number().over(by))
    places = numbered.select("qid", "__n", F.col("chunk_id").alias("seed"), "doc_id", "page_idx", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index"), F.col("chunk_index") + 1)).alias("chunk_index"))
    option = F.struct((-F.col(score)).alias("o"), "chunk_id")
    near = places.join(ranked.select("qid", "doc_id", "page_idx", "chunk_index", "chunk_id", score), ["qid", "doc_id", "page_idx", "chunk_index"]).groupBy("qid", "__n", "seed").agg(F.array_sort(F.collect_list(option)).alias("options"))
    turns = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("__n", "seed", "options"))).alias("turns"))
    start = seeds.groupBy("qid").agg(F.collect_list("chunk_id").alias("chosen")).join(turns, "qid")
    kind = ranked.schema["chunk_id"].dataType.simpleString()
    begun = F.struct(F.col("chosen").alias("chosen"), F.array().cast(f"array<struct<seed: {kind}, chunk_id: {kind}, score: double>>").alias("added"))

    def step(acc: Column, turn: Column) -> Column:
        free = F.filter(turn["options"], lambda o: ~F.array_contains(acc["chosen"], o["chunk_id"]))
        found = F.get(free, F.lit(0))
        took = F.struct(F.concat(acc["chosen"], F.array(found["chunk_id"])).alias("chosen"), F.concat(acc["added"], F.array(F.struct(turn["seed"].alias("seed"), found["chunk_id"].alias("chunk_id"), F.round(clip01(-found["o"] + 0.02), 8).alias("score")))).alias("added"))
        return F.when((F.size(acc["chosen"]) >= most) | (F.size(free) == 0), acc).otherwise(took)

    added = start.select("qid", F.explode(F.aggregate("turns", begun, step, lambda acc: acc["added"])).alias("x")).select("qid", "x.chunk_id", "x.seed", "x.score")
    own = seeds.select("qid", "chunk_id", F.lit(None).cast(kind).alias("seed"), F.col(score).cast("double").alias("score"))
    return own.unionByName(added)


def protected(candidates: DataFrame, lexical: Column, k: int, pool: int) -> DataFrame:
    """qid, chunk_id, protection_score of lexically strong candidates that a model must not push out."""
    most = min(max(2 * k, 12), max(0, pool - k))
    bonus = F.when(F.exists("source_channels", lambda c: F.lower(c).isin("bm25", "sparse")), 0.05).otherwise(0.0)
    rows = candidates.withColumn("lexical", lexical).where((F.col("bm25_score") >= 0.45) & (F.col("lexical") >= 0.04))
    rows = rows.withColumn("protection_score", F.round(0.75 * F.col("bm25_score") + 0.20 * F.col("lexical") + bonus, 8))
    w = Window.partitionBy("qid").orderBy(F.col("protection_score").desc(), "chunk_id")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("qid", "chunk_id", "protection_score")


def with_table_quota(candidates: DataFrame, k: int, quota: int, score: str = "rank_score") -> DataFrame:
    """The k rows of each question: for table questions the best `quota` tables first, then the others by score."""
    by = [F.col(score).desc(), F.col("chunk_id")]
    tables = Window.partitionBy("qid", "chunk_type").orderBy(*by)
    first = (F.col("query_type") == "table_qa") & (F.col("chunk_type") == "table") & (F.row_number().over(tables) <= min(quota, k))
    final = Window.partitionBy("qid").orderBy(F.col("__first").desc(), *by)
    return candidates.withColumn("__first", first).withColumn("place", F.row_number().over(final)).where(F.col("place") <= k).drop("__first")


def model_scores(candidates: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """Rows with score columns by a pair model over (question, pair text), brought to [0, 1] within the question.

    A batch for which the model fails, or gives another number of scores than
    it has rows, has none; a question with such a row ranks by its recall score.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for question, text in batches:
            try:
                found = list(scorer(question.tolist(), text.tolist()))
            except Exception:  # whatever a model raises, its rows are ranked without it
                found = []
            yield pd.Series(found if len(found) == len(question) else [None] * len(question), dtype="float64")

    rows = candidates.withColumn("__pair", pair_text(candidates)).withColumn("model_score", scored("question", "__pair")).drop("__pair")
    rows = rows.withColumn("__whole", F.count("model_score").over(Window.partitionBy("qid")) == F.count(F.lit(1)).over(Window.partitionBy("qid")))
    rows = rows.withColumn("final_score", F.when(F.col("__whole"), relative("model_score", "qid")).otherwise(recall_score(candidates)))
    rows = rows.withColumn("score_source", F.when(F.col("__whole"), "model_score").otherwise("hybrid_recall_score")).drop("__whole")
    w = Window.partitionBy("qid").orderBy(F.col("final_score").desc(), "chunk_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
