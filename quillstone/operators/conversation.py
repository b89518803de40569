"""Conversations turn by turn: what each question's route may use of the session before it, and the focus that each answer leaves.

Messages: session_id, place (their order), role, content; on answers decision
(answer, clarify, refuse), query_type, effective_question, slots
(map<string,string>), missing_slots, doc_sources and n_citations; on questions
the route that a model or a rule proposes: proposed_type, proposed_source,
proposed_question, proposed_history, history_refs, missing_info, confidence. Columns that are not
there count as null.

followed() is the whole history as windows over a session's messages in order,
which stream and spill; no session is gathered. streaming.conversations keeps the
same state from batch to batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, clip01, normalize_whitespace
from .questions import query_type, slots

#: Turn types, sources of context, the threshold of confidence, and what a focus keeps of slots.
TURN_TYPES = ("new_rag_query", "follow_up", "clarification_reply", "citation_followup", "meta_question")
CONTEXT_SOURCES = ("none", "clarification_pending", "conversation_focus", "recent_history", "last_evidence")
LOW_CONFIDENCE = 0.55
FOCUS_SLOTS = ("company", "entity", "period", "metric", "scope", "table_name", "unit", "focus")

COLUMNS = {
    "session_id": None, "place": None, "role": "string", "content": "string", "decision": "string", "query_type": "string", "effective_question": "string",
    "slots": "map<string,string>", "missing_slots": "array<string>", "doc_sources": "array<string>", "n_citations": "int",
    "proposed_type": "string", "proposed_source": "string", "proposed_question": "string", "history_refs": "array<string>", "missing_info": "array<string>", "confidence": "double", "proposed_history": "boolean",
}

FOCUS = "struct<active_topic: string, last_query_type: string, updated_at: long, years: array<string>, doc_scope: array<string>, " + ", ".join(f"{s}: string" for s in FOCUS_SLOTS) + ">"

#: What followed() and the stream give for each question and answer.
RESULT = {
    "turn": "int", "status": "string", "turn_type": "string", "context_source": "string", "should_use_history": "boolean", "effective_question": "string", "refs": "array<string>", "missing": "array<string>",
    "confidence": "double", "requires_clarification": "boolean", "policy_reason": "string", "pending_turn": "int", "focus": FOCUS,
}


def _text(c: str) -> Column:
    return F.nullif(normalize_whitespace(F.col(c), False), F.lit(""))


def _filled(c: str) -> Column:
    """An array without blank items; null is empty."""
    return F.coalesce(F.filter(F.col(c), lambda x: normalize_whitespace(x, False) != ""), F.array().cast("array<string>"))


def prepared(messages: DataFrame) -> DataFrame:
    """Questions and answers with clean columns; found: the slots of their text, over which those given win."""
    rows = messages.select(*[(F.col(c) if c in messages.columns else F.lit(None).cast(kind)).alias(c) for c, kind in COLUMNS.items()])
    rows = rows.withColumn("role", F.lower(F.coalesce(_text("role"), F.lit("")))).where(F.col("role").isin("user", "assistant"))
    rows = rows.withColumns({c: _text(c) for c in ("content", "query_type", "effective_question", "proposed_type", "proposed_source", "proposed_question")})
    rows = rows.withColumns({c: _filled(c) for c in ("missing_slots", "doc_sources", "history_refs", "missing_info")})
    rows = rows.withColumns({"decision": F.lower(_text("decision")), "doc_sources": F.array_distinct("doc_sources"), "n_citations": F.coalesce("n_citations", F.lit(0)), "confidence": clip01(F.coalesce("confidence", F.lit(0.0)))})
    text = F.coalesce("effective_question", F.when(F.col("role") == "user", F.col("content")), F.lit(""))
    found = slots(text, query_type(text))
    own = lambda n: F.coalesce(clean(F.col("slots")[n]), clean(found[n]) if n in ("period", "metric", "scope") else F.lit(None).cast("string"))
    years = F.when(F.size(found["years"]) > 0, found["years"])
    return rows.withColumn("found", F.struct(years.alias("years"), *[own(n).alias(n) for n in FOCUS_SLOTS])).drop("slots")


def status(decision: Column) -> Column:
    return F.when(decision == "clarify", "clarification_pending").when(decision == "answer", "completed").when(decision == "refuse", "refused").otherwise("unknown")


def with_policy(rows: DataFrame) -> DataFrame:
    """Routes of questions (prepared columns; pending: struct<turn, question>, has_focus, has_evidence, n_turns before them) after the policy."""
    pending, focus, evidence = F.col("pending").isNotNull(), F.col("has_focus"), F.col("has_evidence")
    proposed = F.when(F.col("proposed_type").isin(*TURN_TYPES), F.col("proposed_type")).otherwise("new_rag_query")
    source = F.when(F.col("proposed_source").isin(*CONTEXT_SOURCES), F.col("proposed_source")).otherwise("none")
    asked, refs = F.coalesce("content", F.lit("")), F.col("history_refs")
    first = (F.col("n_turns") == 0) & ~pending & ~focus & ~evidence
    low = ~first & (F.col("confidence") > 0) & (F.col("confidence") < LOW_CONFIDENCE)
    is_a = lambda name: ~first & ~low & (proposed == name)
    reply, follow, cite, meta = is_a("clarification_reply") & pending, is_a("follow_up") & focus, is_a("citation_followup") & evidence, is_a("meta_question")
    loose = is_a("follow_up") & ~focus & (F.size(refs) > 0)  # a follow-up that names its history
    kept = reply | follow | cite | meta | loose
    turn_id = F.concat(F.lit("turn_"), F.col("pending.turn"))
    named = lambda x: F.when(F.size(refs) > 0, refs).otherwise(F.array(x))
    none = F.array().cast("array<string>")
    question = F.coalesce("proposed_question", asked)
    joined = normalize_whitespace(F.concat_ws(" ", "pending.question", asked), False)
    return rows.withColumns(
        {
            "turn_type": F.when(kept, proposed).when(low & pending, "clarification_reply").otherwise("new_rag_query"),
            "context_source": F.when(reply | (low & pending), "clarification_pending").when(follow, "conversation_focus").when(cite, "last_evidence").when(meta, F.when(source == "none", "recent_history").otherwise(source)).when(loose, source).otherwise("none"),
            "should_use_history": reply | follow | cite | meta | (low & pending) | (loose & F.coalesce("proposed_history", F.lit(False))),
            "effective_question": F.when(first, asked).when(reply & (question == asked), joined).otherwise(question),
            "refs": F.when(reply, named(turn_id)).when(follow, named(F.lit("focus"))).when(cite, named(F.lit("last_evidence"))).when(meta | loose | low | is_a("clarification_reply") | is_a("citation_followup"), refs).otherwise(none),
            "missing": F.when(first, none).when(low & (F.size("missing_info") == 0), F.array(F.lit("conversation_context"))).otherwise(F.col("missing_info")),
            "confidence": F.when(first, F.lit(1.0)).otherwise(F.col("confidence")),
            "requires_clarification": low,
            "policy_reason": F.when(first, "new_session_fast_path").when(low, "turn_router_low_confidence"),
        }
    )


def followed(messages: DataFrame) -> DataFrame:
    """session_id, place, role and RESULT of each question and answer.

    For a question: its route, the turn that waits for a clarification, and the
    focus before it. For an answer of a question: turn number, status and the
    focus after it; an answer that no question precedes is no turn. The answer
    to a new question starts a new focus, that to another adds to the old one,
    and a refusal or a clarification leaves it as it is.
    """
    order = Window.partitionBy("session_id").orderBy("place", F.col("role").desc())
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = prepared(messages)
    answer = F.col("role") == "assistant"
    rows = rows.withColumn("is_turn", answer & (F.coalesce(F.lag("role").over(order), F.lit("")) == "user"))
    asked = F.lag("content").over(order)
    rows = rows.withColumns({"status": status(F.col("decision")), "topic": F.coalesce("effective_question", asked), "found": F.when(F.col("is_turn") & F.col("effective_question").isNull(), _over(F.lag("found").over(order), F.col("found"))).otherwise(F.col("found"))})
    rows = rows.withColumn("n_turns", F.count_if("is_turn").over(so_far).cast("int"))
    last = F.last(F.when(F.col("is_turn"), F.struct("status", F.col("n_turns").alias("turn"), F.col("topic").alias("question"))), ignorenulls=True).over(earlier)
    proof = F.last(F.when(answer, (F.size("doc_sources") > 0) | (F.col("n_citations") > 0)), ignorenulls=True).over(earlier)
    updates = F.col("is_turn") & ~F.col("status").isin("refused", "clarification_pending")
    rows = rows.withColumns({"last": last, "has_evidence": F.coalesce(proof, F.lit(False)), "updates": updates})
    rows = rows.withColumns({"pending": F.when(F.col("last.status") == "clarification_pending", F.col("last")), "has_focus": F.coalesce(F.max("updates").over(earlier), F.lit(False))})
    rows = with_policy(rows)
    # runs of answers that add to one focus
    fresh = F.col("updates") & (F.lag("turn_type").over(order) == "new_rag_query")
    rows = rows.withColumn("run", F.count_if(fresh).over(so_far))
    in_run = Window.partitionBy("session_id", "run").orderBy("place", F.col("role").desc()).rowsBetween(Window.unboundedPreceding, 0)
    newest = lambda c: F.last(F.when(F.col("updates"), c), ignorenulls=True).over(in_run)
    basic = newest(F.struct(F.col("topic").alias("active_topic"), F.col("query_type").alias("last_query_type"), F.col("place").cast("long").alias("updated_at")))
    rows = rows.withColumns({"f_basic": basic, "f_years": newest(F.col("found.years")), "f_docs": newest(F.when(F.size("doc_sources") > 0, F.col("doc_sources"))), **{f"f_{s}": newest(F.col(f"found.{s}")) for s in FOCUS_SLOTS}})
    focus = F.struct(*[F.col(f"f_basic.{n}").alias(n) for n in ("active_topic", "last_query_type", "updated_at")], F.col("f_years").alias("years"), F.col("f_docs").alias("doc_scope"), *[F.col(f"f_{s}").alias(s) for s in FOCUS_SLOTS])
    user = F.col("role") == "user"
    only = {c: F.when(user, F.col(c)) for c in ("turn_type", "context_source", "should_use_history", "effective_question", "refs", "missing", "confidence", "requires_clarification", "policy_reason")}
    out = rows.withColumns({"turn": F.when(F.col("is_turn"), F.col("n_turns")), "status": F.when(F.col("is_turn"), F.col("status")), "pending_turn": F.when(user, F.col("pending.turn")), "focus": F.when(F.col("f_basic").isNotNull(), focus), **only})
    return out.select("session_id", "place", "role", *[F.col(c).cast(kind).alias(c) for c, kind in RESULT.items()])


def _over(base: Column, own: Column) -> Column:
    """Slots of a question under those that its answer brings."""
    return F.struct(F.coalesce(base["years"], own["years"]).alias("years"), *[F.coalesce(own[s], base[s]).alias(s) for s in FOCUS_SLOTS])
