import pytest
from pyspark.sql import functions as F

from quillstone.operators import conversation as C
from quillstone.streaming import conversations as S

SCHEMA = "session_id string, place int, role string, content string, decision string, query_type string, effective_question string, slots map<string,string>, doc_sources array<string>, n_citations int, proposed_type string, proposed_source string, proposed_question string, history_refs array<string>, confidence double, proposed_history boolean"


def ask(s, place, content, kind=None, confidence=0.9, source=None, question=None, refs=None, history=None):
    return (s, place, "user", content, None, None, None, None, None, None, kind, source, question, refs, confidence, history)


def reply(s, place, decision="answer", kind="fact_lookup", effective=None, slots=None, docs=(), cited=0, content="It is so."):
    return (s, place, "assistant", content, decision, kind, effective, slots, list(docs), cited, None, None, None, None, None, None)


MESSAGES = [
    # asked back, answered, followed up, cited, history asked for
    ask("a", 0, "What was it"), reply("a", 1, "clarify"),
    ask("a", 2, "in 2021", "clarification_reply"), reply("a", 3, effective="What was it in 2021", slots={"company": "Acme", "unit": " "}, docs=["r1", "r1", "r2"], cited=1),
    ask("a", 4, "and the year before?", "follow_up"), reply("a", 5, slots={"metric": "margin"}),
    ask("a", 6, "Which page?", "citation_followup"), reply("a", 7, "refuse"),
    ask("a", 8, "Which page again?", "citation_followup"), reply("a", 9, docs=["r3"]),
    ask("a", 10, "What did I ask?", "meta_question"), reply("a", 11),
    ask("a", 12, "Something else of 2019", "new_rag_query", refs=["turn_1"]), reply("a", 13, None),
    ask("a", 14, "hm", "follow_up", confidence=0.3), reply("a", 15, "clarify", content="What do you mean?"),
    ask("a", 16, "that one", "follow_up", confidence=0.3),
    ask("a", 17, "that one", "clarification_reply", question="That one, in full", refs=["turn_8"]), reply("a", 18), reply("a", 19, "refuse", docs=["unasked"]),
    ask("a", 20, "x", "citation_followup"),
    # no history: whatever is proposed is new; loose follow-ups; nonsense proposals; a reply to nothing
    ask("b", 0, "hello", "meta_question", 0.2), ask("b", 1, " hello again "), reply("b", 2, "refuse"),
    ask("b", 3, "more", "follow_up"), reply("b", 4, "refuse"), ask("b", 5, "more", "follow_up", refs=["turn_1"], source="recent_history", history=True), reply("b", 6),
    ask("b", 7, "well", "no such type", source="nowhere"), reply("b", 8, "Answer "), ask("b", 9, "no", "clarification_reply", refs=["turn_9", " "]),
    # an answer without a question, other roles, empty texts
    reply("c", 0), ("c", 1, "system", "be nice", *[None] * 12), ask("c", 2, None, "follow_up", None), reply("c", 3, effective=" "), ask("c", 4, "", "follow_up"),
]


def plain(df):
    return {(r["session_id"], r["place"]): r.asDict(recursive=True) for r in df.collect()}


def test_turns(spark):
    got = plain(C.followed(spark.createDataFrame(MESSAGES, SCHEMA)))
    route = lambda s, p: tuple(got[s, p][c] for c in ("turn_type", "context_source", "should_use_history", "effective_question", "refs"))
    assert got["a", 0]["policy_reason"] == "new_session_fast_path" and got["a", 0]["confidence"] == 1.0
    assert route("a", 2) == ("clarification_reply", "clarification_pending", True, "What was it in 2021", ["turn_1"]) and got["a", 2]["pending_turn"] == 1
    first = got["a", 3]["focus"]
    assert (first["active_topic"], first["company"], first["period"], first["years"], first["doc_scope"], first["unit"]) == ("What was it in 2021", "Acme", "2021", ["2021"], ["r1", "r2"], None)
    assert route("a", 4) == ("follow_up", "conversation_focus", True, "and the year before?", ["focus"]) and got["a", 4]["focus"] == first
    second = got["a", 5]["focus"]
    assert second["company"] == "Acme" and second["metric"] == "margin" and second["doc_scope"] == ["r1", "r2"] and second["active_topic"] == "and the year before?"
    assert route("a", 6)[:2] == ("new_rag_query", "none")  # the last answer had no evidence
    assert got["a", 7]["focus"] == second and got["a", 7]["status"] == "refused"
    assert route("a", 10)[:3] == ("meta_question", "recent_history", True)
    assert got["a", 9]["focus"]["doc_scope"] == ["r3"] and got["a", 9]["focus"]["company"] is None  # the answer to a new question
    assert route("a", 12)[4] == [] and got["a", 13]["focus"]["years"] == ["2019"] and got["a", 13]["status"] == "unknown"
    assert route("a", 14)[0] == "new_rag_query" and got["a", 14]["requires_clarification"] and got["a", 14]["missing"] == ["conversation_context"]
    assert route("a", 16)[:3] == ("clarification_reply", "clarification_pending", True)
    assert route("a", 17)[3:] == ("That one, in full", ["turn_8"])
    assert got["a", 19]["turn"] is None and got["a", 18]["turn"] == 9
    assert route("a", 20)[:2] == ("citation_followup", "last_evidence")
    assert route("b", 0)[0] == "new_rag_query" and route("b", 1)[3] == "hello again"
    assert route("b", 3)[0] == "new_rag_query" and route("b", 5) == ("follow_up", "recent_history", True, "more", ["turn_1"])
    assert route("b", 7)[:2] == ("new_rag_query", "none") and route("b", 9) == ("new_rag_query", "none", False, "no", ["turn_9"])
    assert got["c", 0]["focus"] is None and route("c", 4)[0] == "follow_up"
    assert ("c", 1) not in got
    types = {r["turn_type"] for r in got.values()} - {None}
    assert types == set(C.TURN_TYPES) and {r["context_source"] for r in got.values()} - {None} == set(C.CONTEXT_SOURCES)


@pytest.mark.parametrize("cuts", [(99,), (2, 5, 6, 13, 17)])
def test_stream_equals_batch(spark, tmp_path, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        whole = spark.createDataFrame(MESSAGES, SCHEMA)
        low = -1
        for n in (*cuts, 99):
            part = whole.where((F.col("place") > low) & (F.col("place") <= n))
            if not part.isEmpty():
                part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
                low = n
            read = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
            S.stream_followed(read).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        # a repeated file gives nothing
        whole.where("place < 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.stream_followed(read).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        streamed = spark.read.parquet(str(tmp_path / "out"))
        batch = C.followed(whole)
        assert streamed.count() == batch.count() and plain(streamed.select(batch.columns)) == plain(batch)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
