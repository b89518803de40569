"""Sessions: messages (session_id, place, role, content) listed, paired and cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, short_id


def latest(messages: DataFrame, role: str) -> DataFrame:
    """The last message of a role in each session."""
    return messages.where(F.col("role") == role).groupBy("session_id").agg(F.max("place").alias("place"), F.max_by("content", "place").alias("content"))


def listing(messages: DataFrame) -> DataFrame:
    """By session: counts, last user question, title, last answer, last place."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "user").alias("turn_count"), F.max("place").alias("last_place"))
    user = latest(messages, "user").select("session_id", F.col("content").alias("last_user_question"))
    answer = latest(messages, "assistant").select("session_id", F.col("content").alias("last_answer"), F.col("place").alias("last_answer_place"))
    out = counts.join(user, "session_id", "left").join(answer, "session_id", "left")
    return out.withColumn("title", F.substring(F.coalesce(F.nullif(F.trim("last_user_question"), F.lit("")), F.lit("-")), 1, 80))


def page(listed: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page of a listing (1 to 100 rows) with has_more."""
    limit = max(1, min(limit, 100))
    rows = listed.orderBy(*order).offset(max(0, offset)).limit(limit + 1)
    # at most 101 rows
    numbered = rows.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    more = F.max("__n").over(Window.partitionBy()) > limit
    return numbered.withColumn("has_more", more).where(F.col("__n") <= limit).drop("__n")


def turns(messages: DataFrame) -> DataFrame:
    """Each answer with the latest question that no answer took before it; other messages are left out."""
    w = Window.partitionBy("session_id").orderBy("place")
    rows = messages.where(F.col("role").isin("user", "assistant")).withColumns({"before": F.lag("role").over(w), "question": F.lag("content").over(w), "question_place": F.lag("place").over(w)})
    rows = rows.where((F.col("role") == "assistant") & (F.col("before") == "user"))
    return rows.select("session_id", F.row_number().over(w).alias("turn"), "question_place", "place", "question", F.substring("content", 1, 240).alias("answer_summary"))


def last_turns(messages: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    return turns(messages).withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def loaded(messages: DataFrame) -> DataFrame:
    """Each session's messages in order, a user's message before an answer of the same place."""
    item = F.struct("place", F.when(F.col("role") == "user", 0).otherwise(1).alias("later"), "role", "content")
    return messages.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("messages"))


def deleted(tables: dict[str, DataFrame], session_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the sessions, and how many rows each loses."""
    kept = {k: t.join(session_ids, "session_id", "left_anti") for k, t in tables.items()}
    gone = None
    for k, t in tables.items():
        n = t.join(session_ids, "session_id", "left_semi").agg(F.count("*").alias("n_deleted")).select(F.lit(k).alias("table_name"), "n_deleted")
        gone = n if gone is None else gone.unionByName(n)
    return kept, gone


def saved_turn(tables: dict[str, DataFrame], turn: DataFrame) -> dict[str, DataFrame]:
    """The tables messages, traces, evaluations and sessions after a turn.

    turn: session_id, collection_name, place, question, answer, decision,
    query_type, confidence, trace, metrics, created_at; a session may have
    gained several. A turn is two messages, a trace and an evaluation, with
    ids made from session and place, so that a turn saved twice is there once;
    its session is inserted or touched.
    """
    from .store import touched

    made = lambda kind: short_id(f"{kind}_", F.col("session_id"), F.col("place"))
    common = ["session_id", "created_at"]
    user = turn.select(made("user").alias("message_id"), *common, (2 * F.col("place")).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("decision"), F.lit(None).cast("double").alias("confidence"))
    answer = turn.select(made("assistant").alias("message_id"), *common, (2 * F.col("place") + 1).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), "decision", "confidence")
    trace = turn.select(made("trace").alias("trace_id"), made("assistant").alias("message_id"), *common, "question", "trace")
    grade = turn.select(made("evaluation").alias("evaluation_id"), made("assistant").alias("message_id"), *common, "metrics")

    def added(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
        return stored.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)

    return {
        "messages": added(tables["messages"], user.unionByName(answer), "message_id"),
        "traces": added(tables["traces"], trace, "trace_id"),
        "evaluations": added(tables["evaluations"], grade, "evaluation_id"),
        "sessions": touched(tables["sessions"], turn.groupBy("session_id").agg(F.max_by("collection_name", "created_at").alias("collection_name"), F.max("created_at").alias("updated_at"))),
    }


def listed(rows: DataFrame, where: dict[str, object], *order: Column, limit: int | None = None) -> DataFrame:
    """Stored rows with the given values (None: any), in order, at most limit of them: chunks of a collection or a document, documents by their last change, messages and traces of a session."""
    for name, value in where.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def last_focus(turns: DataFrame) -> DataFrame:
    """By session: the focus that the last completed turn (session_id, turn, status, effective_question, question, query_type, slots) leaves; blank parts are null."""
    done = turns.where("status = 'completed'").groupBy("session_id").agg(F.max_by(F.struct(F.coalesce(clean(F.col("effective_question")), F.col("question")).alias("active_topic"), *[clean(F.col(f"slots.{n}")).alias(n) for n in ("company", "period", "metric", "scope")], F.col("query_type").alias("last_query_type"), F.col("turn").alias("updated_at_turn")), "turn").alias("focus"))
    return done.select("session_id", "focus.*")


def last_evidence(messages: DataFrame) -> DataFrame:
    """By session: evidence and citations of the last answer (session_id, place, role, evidence, citations), empty ones included."""
    return messages.where(F.lower(F.trim("role")) == "assistant").groupBy("session_id").agg(F.max_by(F.struct("evidence", "citations"), "place").alias("x")).select("session_id", "x.*")


def routed(asked: DataFrame, focus: DataFrame, pending: DataFrame, threshold: float = 0.55) -> DataFrame:
    """session_id, turn_type, effective_question of the next question (session_id, question, confidence, proposed).

    proposed is what a model or rule takes the turn for. A session with a
    pending clarification (session_id, original_question) is answered by it; a
    follow-up needs a focus and the threshold; every other turn is new.
    """
    q = asked.join(focus.select("session_id", "active_topic"), "session_id", "left").join(pending.select("session_id", "original_question"), "session_id", "left")
    follows = F.col("proposed").isin("follow_up", "citation_follow_up") & (F.col("confidence") >= threshold) & F.col("active_topic").isNotNull()
    kind = F.when(F.col("original_question").isNotNull() & (F.col("proposed") != "new_question"), "clarification_answer").when(follows, F.col("proposed")).otherwise("new_question")
    q = q.withColumn("turn_type", kind)
    asks = F.when(F.col("turn_type") == "clarification_answer", F.concat_ws(" ", "original_question", "question")).when(F.col("turn_type") != "new_question", F.concat_ws(" ", "active_topic", "question")).otherwise(F.col("question"))
    return q.select("session_id", "turn_type", asks.alias("effective_question"))
