"""Evidence gates, citations and self-evaluation, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip01, clean


def diagnostics(rows: DataFrame, min_top: float = 0.45, min_avg: float = 0.30) -> DataFrame:
    """By qid: top and mean score, their warning, documents, tables, and confidence."""
    score = clip01(F.col("score"))
    out = rows.groupBy("qid").agg(F.count("*").alias("n_rows"), F.max(score).alias("top"), F.avg(score).alias("avg"), F.count_distinct(clean(F.col("doc_id").cast("string"))).alias("doc_count"), F.count_if(F.col("chunk_type") == "table").alias("table_count"))
    low = (F.col("top") < min_top) | (F.col("avg") < min_avg)
    return out.select("qid", "n_rows", F.round("top", 4).alias("top_score"), F.round("avg", 4).alias("avg_score"), F.when(low, "low_score").otherwise("").alias("score_warning"), "doc_count", "table_count", F.round(clip01((F.col("top") + F.col("avg")) / 2), 4).alias("confidence"))


def gate(questions: DataFrame, rows: DataFrame, retries: int = 0, retry_limit: int = 2, table_quota: int = 1, min_docs: int = 1) -> DataFrame:
    """By qid of the questions (with query_type): decision, reason, confidence and coverage warnings.

    Any row means `answer`: weak scores and thin coverage only warn.
    """
    d = questions.select("qid", "query_type").join(diagnostics(rows), "qid", "left")
    none = F.col("n_rows").isNull()
    kind = F.col("query_type")
    warnings = F.array_compact(
        F.array(
            F.when(~none & (kind == "table_qa") & (F.col("table_count") < max(1, table_quota)), "missing_table_evidence"),
            F.when(~none & (kind == "multi_doc_compare") & (F.col("doc_count") < 2), "multi_doc_evidence_missing"),
            F.when(~none & kind.isin("summarization", "report_generation", "multi_doc_compare") & (F.col("n_rows") < min_docs), "insufficient_doc_coverage"),
        )
    )
    empty = ("retry", "no_evidence") if retries < retry_limit else ("refuse", "no_evidence_after_retry")
    return d.select("qid", "query_type", F.when(none, empty[0]).otherwise("answer").alias("decision"), F.when(none, empty[1]).otherwise("evidence_available").alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.array_join(warnings, ",").alias("coverage_warnings"))


def citations(rows: DataFrame, quote: int = 240) -> DataFrame:
    """Ranked evidence with ids E1.. and C1.. and a quote."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_id"))
    return rows.withColumn("n", rank).select("qid", "chunk_id", F.concat(F.lit("E"), F.col("n")).alias("evidence_id"), F.concat(F.lit("C"), F.col("n")).alias("citation_id"), F.col("n").alias("rank"), F.substring("content", 1, quote).alias("quote"), F.round(clip01(F.col("score")), 6).alias("confidence"))


def first_of_each_source(rows: DataFrame) -> DataFrame:
    """The best ranked row of each document source of a question, as a comparison needs it."""
    return rows.groupBy("qid", "doc_source").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"), F.min("rank").alias("rank"))


def evaluation(answer: Column, decision: Column, n_citations: Column, n_evidence: Column) -> dict[str, Column]:
    """Shape scores of an answer: grounding, completeness, consistency, overall."""
    density = F.least(F.lit(1.0), n_citations / F.greatest(n_evidence, F.lit(1)))
    none = n_evidence == 0
    grounding = F.when(decision == "answer", density).when(decision == "clarify", 1.0).when(none, 0.0).otherwise(density)
    blank = F.trim(F.coalesce(answer, F.lit(""))) == ""
    length = F.least(F.lit(1.0), F.length(F.coalesce(answer, F.lit(""))) / 120.0)
    complete = F.when((decision == "answer") & blank, 0.0).when(decision == "clarify", 1.0).when(decision == "refuse", F.when(none, 0.0).otherwise(0.5)).otherwise(length)
    consistent = F.when(decision.isin("answer", "refuse") & none, 0.0).otherwise(1.0)
    return {"grounding_score": F.round(grounding, 4), "completeness_score": F.round(complete, 4), "consistency_score": F.round(consistent, 4), "overall_score": F.round((grounding + complete + consistent) / 3.0, 4)}


def keyword_recall(keywords: Column, text: Column) -> Column:
    """Share of the keywords that the text has; null without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) > 0, found / F.size(keywords))
