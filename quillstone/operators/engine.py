"""The whole path of questions: understanding, search over variants and routes, merge, dedupe, neighbours, model, quota, gate, audit, retries, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coarse_tokens, token_overlap
from . import answers, candidates, evidence, questions, rerank, retrieval


@dataclass
class Config:
    top_k: int = 5
    pool: int = 40
    table_quota: int = 2
    retry_limit: int = 1
    #: a pair model: (questions, texts) -> scores; without one, or where it fails, the recall score ranks
    scorer: Callable[[list[str], list[str]], list[float]] | None = None


def searched(corpus: DataFrame, asked: DataFrame, config: Config) -> DataFrame:
    """Merged hits of all routes for questions (qid, question, query_type, variants[, question_vector]) over corpus (chunk_id, doc_id, doc_source, chunk_type, content[, vector]).

    Every variant is searched by BM25 in texts and in tables, and densely: by
    the given vectors, or by the texts' hash vectors.
    """
    each = asked.select("qid", F.posexplode("variants").alias("variant", "question")).withColumn("qid", F.struct("qid", "variant"))
    kind = F.coalesce("chunk_type", F.lit("text"))
    routes = [
        ("bm25", "bm25_score", retrieval.bm25(corpus.where(kind != "table"), each, config.pool)),
        ("table", "bm25_score", retrieval.bm25(corpus.where(kind == "table"), each, config.pool)),
    ]
    if "vector" in corpus.columns and "question_vector" in asked.columns:
        dense = retrieval.dense(corpus, asked, config.pool).withColumn("qid", F.struct("qid", F.lit(0).alias("variant")))
    else:
        dense = retrieval.hash_dense(corpus, each, config.pool)
    routes.append(("dense", "dense_score", dense))
    rows = [r.select(F.col("qid.qid").alias("qid"), "chunk_id", F.lit(name).alias("route"), F.col(score).alias("score")) for name, score, r in routes]
    return retrieval.merged(*rows).join(corpus.drop("vector"), "chunk_id")


def reranked(merged: DataFrame, asked: DataFrame, config: Config) -> DataFrame:
    """The top_k rows of each question: near-duplicates go, neighbours of the best rise, lexically strong rows are kept for the model, tables have their quota."""
    kept = rerank.deduplicated(merged, pool=4 * config.pool).select("qid", "chunk_id")
    rows = merged.join(kept, ["qid", "chunk_id"]).join(asked.select("qid", "question", "query_type"), "qid")
    rows = rows.withColumn("rank_score", candidates.recall_score(rows))
    if {"page_idx", "chunk_index"} <= set(rows.columns):
        seeds = retrieval.top(rows, config.top_k, F.col("rank_score"), "qid")
        near = rerank.supplemented(seeds, rows, config.top_k, "rank_score").where("seed IS NOT NULL").select("qid", "chunk_id", F.col("score").alias("near"))
        rows = rows.join(near, ["qid", "chunk_id"], "left").withColumn("rank_score", F.greatest("rank_score", F.coalesce("near", F.lit(0.0)))).drop("near")
    if config.scorer:
        best = retrieval.top(rows, config.pool, F.col("rank_score"), "qid").select("qid", "chunk_id", "rank")
        lexical = token_overlap(coarse_tokens(F.col("question")), coarse_tokens(F.col("content")))
        strong = rerank.protected(rows, lexical, config.top_k, config.pool)
        strong = retrieval.top(strong, config.pool, F.col("protection_score"), "qid").select("qid", "chunk_id", "rank")
        pool = candidates.merged_pools(config.pool, strong, best).select("qid", "chunk_id")
        rows = rerank.model_scores(rows.join(pool, ["qid", "chunk_id"]), config.scorer, config.pool).withColumn("rank_score", F.col("final_score"))
    best = rerank.with_table_quota(rows, config.top_k, config.table_quota)
    return best.withColumn("score", F.col("rank_score")).withColumn("rank", F.col("place")).drop("question", "query_type")


def found(corpus: DataFrame, asked: DataFrame, config: Config) -> DataFrame:
    """Ranked evidence of questions."""
    return reranked(searched(corpus, asked, config), asked, config)


def asked_and_answered(corpus: DataFrame, asked: DataFrame, config: Config | None = None, kept: list[DataFrame] | None = None) -> DataFrame:
    """qid, query_type, decision, answer, confidence for each question (qid, question).

    Questions that lack a slot are asked back; those whose evidence the audit
    finds wanting are searched again with the suggested query, up to
    retry_limit times. Evidence of a step (at most top_k rows for each
    question) is persisted, as several steps read it; the frames are added to
    `kept`, for the caller to release once the answers are written.
    """
    config, kept = config or Config(), [] if kept is None else kept

    def hold(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return kept[-1]

    known = hold(questions.understood(asked))
    ready = known.where("decision = 'retrieve'")
    rows = hold(found(corpus, ready, config))
    audit = answers.audited(ready, rows)
    tries = 0
    while tries < config.retry_limit:
        again = hold(ready.join(audit.where("semantic_decision = 'retry'").select("qid", "suggested_retry_query"), "qid"))
        if again.isEmpty():
            break
        tries += 1
        second = found(corpus, again.withColumn("variants", F.array("suggested_retry_query")), config)
        rows = hold(rows.join(again.select("qid"), "qid", "left_anti").unionByName(second.select(*rows.columns)))
        audit = answers.audited(ready, rows)
    gates = answers.merged_gate(evidence.gate(ready, rows, retries=config.retry_limit, retry_limit=config.retry_limit, table_quota=config.table_quota), audit)
    out = answers.answered(ready, rows).select("qid", "answer", "confidence")
    decision = F.when(F.col("decision") == "retry", "answer").otherwise(F.col("decision"))
    done = gates.select("qid", "query_type", decision.alias("decision"), "reason").join(out, "qid", "left")
    # no more retries: a question without evidence is refused, by its reason
    refused = (F.col("decision") == "refuse") | F.col("answer").isNull()
    done = done.select("qid", "query_type", F.when(refused, "refuse").otherwise(F.col("decision")).alias("decision"), F.when(refused, answers.refusal(F.col("query_type"), F.col("reason"))).otherwise(F.col("answer")).alias("answer"), F.when(refused, 0.0).otherwise(F.col("confidence")).alias("confidence"))
    back = known.where("decision = 'clarify'").select("qid", "query_type", "decision", answers.clarification(F.array_join("missing", ",")).alias("answer"), F.lit(0.0).alias("confidence"))
    return done.unionByName(back)
