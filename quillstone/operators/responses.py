"""Responses with everything that led to them: evidence, citations, evaluation, and a trace of each stage.

respond() takes questions through the stages of engine, one after the other. A
stage's rows are written once and observed while they are: how many they are,
their best score, and how long they took. What a stage did for a question is
counted from those tables. So a question that is asked back, or refused for
want of evidence, has a trace as well, with zeros for what it never reached.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import answers, candidates, engine, evidence, questions, rerank
from .shared import written

_STAGE = "struct<round: int, stage: string, rows: long, top_score: double, ms: long>"


@dataclass
class Stages:
    """The stages so far: (round, name, rows, best score, milliseconds) of each, for all questions together."""

    done: list[tuple] = field(default_factory=list)

    def ran(self, number: int, name: str, df: DataFrame, score: str | None = None) -> DataFrame:
        seen = Observation(f"{name}_{number}")
        began = time.monotonic()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), (F.max(score) if score else F.max(F.lit(None).cast("double"))).alias("top")))
        self.done.append((number, name, seen.get["rows"], seen.get["top"], round(1000 * (time.monotonic() - began))))
        return out


def _filtered(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits that fit their question's collection_name and chunk_type, where it names one; a chunk without a type is text."""
    names = [c for c in ("collection_name", "chunk_type") if c in asked.columns and c in rows.columns]
    if not names:
        return rows
    want = asked.select("qid", *[F.col(c).alias(f"__{c}") for c in names])
    own = {"chunk_type": F.coalesce("chunk_type", F.lit("text"))}
    for c in names:
        fits = F.col(f"__{c}").isNull() | (F.col(f"__{c}") == own.get(c, F.col(c)))
        rows = rows.join(F.broadcast(want.select("qid", f"__{c}")), "qid").where(fits).drop(f"__{c}")
    return rows


def _boosted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """metadata_boost and table_boost of each row, of the columns that it has."""
    of = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    rows = rows.join(asked.select("qid", F.col("question").alias("__q"), F.col("query_type").alias("__t")), "qid")
    page = F.coalesce(of("page_idx").cast("int"), F.lit(-9))
    from ..functions.text import page_hint

    metadata = rerank.metadata_boost(F.col("__q"), of("heading_path"), [of(f"level{i}_title") for i in (1, 2, 3)], of("doc_source"), page, F.coalesce(page_hint(F.col("__q")), F.lit(-99)))
    table = rerank.table_boost(F.col("__q"), F.col("__t"), F.coalesce(of("chunk_type"), F.lit("")), of("table_header_text"), of("table_context_text"))
    return rows.withColumns({"metadata_boost": F.round(F.coalesce(metadata, F.lit(0.0)), 6), "table_boost": F.round(F.coalesce(table, F.lit(0.0)), 6)}).drop("__q", "__t")


def _counted(merged: DataFrame, selected: DataFrame) -> DataFrame:
    """By question: candidates and those of each route, and of the rows selected how many are tables or were brought in as neighbours."""
    has = lambda c: F.count_if(F.array_contains("source_channels", c)).alias(f"n_{c}")
    before = merged.groupBy("qid").agg(F.count("*").alias("n_candidates"), has("dense"), has("bm25"), has("table"))
    after = selected.groupBy("qid").agg(F.count("*").alias("n_selected"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"), F.max("score").alias("top_score"))
    return before.join(after, "qid", "left")


def respond(corpus: DataFrame, asked: DataFrame, config: engine.Config | None = None) -> DataFrame:
    """qid, question, query_type, decision, answer, confidence, evidence, citations, evaluation and trace of each question.

    asked: qid, question, and collection_name or chunk_type to search only
    those. Questions whose evidence the audit finds wanting are searched again,
    up to config.retry_limit times; what they find then replaces what they had.
    trace: query variants, missing slots, counts of the last round, rounds, the
    gate's decision and reason, the audit's, and the stages of the batch.
    """
    config, stages = config or engine.Config(), Stages()
    given = [c for c in ("collection_name", "chunk_type", "question_vector") if c in asked.columns]
    known = stages.ran(0, "understand", questions.understood(asked.select("qid", "question", *given)))
    ready = known.where("decision = 'retrieve'")

    def searched(number: int, some: DataFrame) -> tuple[DataFrame, DataFrame]:
        merged = stages.ran(number, "retrieve", _filtered(engine.searched(corpus, some, config), some), "retrieval_score")
        rows = stages.ran(number, "rerank", _boosted(engine.reranked(merged, some, config), some), "score")
        return rows, written(_counted(merged, rows).withColumn("rounds", F.lit(number)))

    rows, counts = searched(1, ready)
    audit = stages.ran(1, "audit", answers.audited(ready, rows))
    for number in range(2, config.retry_limit + 2):
        again = written(ready.join(audit.where("semantic_decision = 'retry'").select("qid", "suggested_retry_query"), "qid"))
        if again.isEmpty():
            break
        more, more_counts = searched(number, again.withColumn("variants", F.array("suggested_retry_query")))
        ids = again.select("qid")
        rows = written(rows.join(ids, "qid", "left_anti").unionByName(more.select(*rows.columns)))
        counts = written(counts.join(ids, "qid", "left_anti").unionByName(more_counts).unionByName(ids.join(more_counts, "qid", "left_anti").select("qid", *[F.lit(None).cast(t).alias(c) for c, t in more_counts.drop("qid", "rounds").dtypes], F.lit(number).alias("rounds"))))
        audit = stages.ran(number, "audit", answers.audited(ready, rows))
    gates = stages.ran(0, "gate", answers.merged_gate(evidence.gate(ready, rows, retries=config.retry_limit, retry_limit=config.retry_limit, table_quota=config.table_quota), audit))
    told = stages.ran(0, "answer", answers.answered(ready, rows).select("qid", "answer", "confidence"), "confidence")

    hits = candidates.response(rows.join(evidence.citations(rows).select("qid", "chunk_id", "evidence_id", "citation_id", "quote"), ["qid", "chunk_id"]))
    extra = rows.select("qid", "chunk_id", "metadata_boost", "table_boost", "source_channels", "retrieval_score").join(evidence.citations(rows).select("qid", "chunk_id", "evidence_id", "citation_id", "quote"), ["qid", "chunk_id"])
    hits = hits.drop("citation").join(extra, ["qid", "chunk_id"])
    item = F.struct("rank", *[c for c in hits.columns if c not in ("qid", "rank", "citation_id", "quote")])
    cited = F.struct("rank", "citation_id", "evidence_id", "chunk_id", *[c for c in ("doc_source", "page_idx") if c in hits.columns], "quote")
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("evidence"), F.array_sort(F.collect_list(cited)).alias("citations"))  # at most top_k rows

    gate = gates.select("qid", F.col("decision").alias("gate_decision"), F.col("reason").alias("gate_reason"))
    checked = audit.select("qid", F.col("semantic_decision").alias("audit_decision"))
    out = known.select("qid", "question", "query_type", "variants", "missing", F.col("decision").alias("first")).join(gate, "qid", "left").join(checked, "qid", "left").join(told, "qid", "left").join(listed, "qid", "left").join(counts, "qid", "left")
    back = F.col("first") == "clarify"
    refused = ~back & ((F.col("gate_decision") == "refuse") | F.col("answer").isNull())
    decision = F.when(back, "clarify").when(refused, "refuse").when(F.col("gate_decision") == "retry", "answer").otherwise(F.col("gate_decision"))
    answer = F.when(back, answers.clarification(F.array_join("missing", ","))).when(refused, answers.refusal(F.col("query_type"), F.coalesce("gate_reason", F.lit("no_evidence")))).otherwise(F.col("answer"))
    none = lambda c: F.coalesce(F.when(~back, F.col(c)), F.array().cast(listed.schema[c].dataType))
    out = out.withColumns({"decision": decision, "answer": answer, "evidence": none("evidence"), "citations": none("citations")})
    grades = evidence.evaluation(F.col("answer"), F.col("decision"), F.size("citations"), F.size("evidence"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    trace = F.struct("variants", "missing", *[zero(c) for c in ("n_candidates", "n_dense", "n_bm25", "n_table", "n_selected", "n_tables", "rounds")], F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "gate_decision", "gate_reason", "audit_decision", _literal(stages.done).alias("stages"))
    return out.select("qid", "question", "query_type", "decision", "answer", F.when(F.col("decision") == "answer", F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"), "evidence", "citations", F.struct(*[g.alias(n) for n, g in grades.items()]).alias("evaluation"), trace.alias("trace"))


def _literal(done: list[tuple]) -> Column:
    names = ("round", "stage", "rows", "top_score", "ms")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in done]).cast(f"array<{_STAGE}>")
