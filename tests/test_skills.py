import json

from pyspark.sql import functions as F

from quillstone.operators import questions as Q
from quillstone.sources import pages
from quillstone.sources import skills as S

FULL = {"skill_name": "Facts", "query_types": ["fact_lookup", " "], "required_slots": ["scope"], "tool_chain": ["search", "answer"], "guardrails": {"cite": True}, "slot_schema": {"scope": {"type": "string"}}, "execution_config": {}, "few_shot_examples": [{"q": "a"}], "tool_constraints": {}}


def page(meta, description="What it does.", template="Answer {question}.", fence="```json"):
    body = meta if isinstance(meta, str) else json.dumps(meta, indent=1)
    sections = "".join(f"\n## {h}\n\n{t}\n" for h, t in (("Task Description", description), ("Prompt Template", template)) if t is not None)
    return f"# A skill\n\n{fence}\n{body}\n```\n{sections}"


def test_each_fault_is_a_reason(spark, tmp_path):
    files = {
        "good": page(FULL),
        "plain": page(FULL | {"skill_name": "Tables", "query_types": ["table_qa"], "required_slots": ["metric", "period"]}, fence="```"),
        "meta": page(FULL | {"skill_name": "FromMeta", "query_types": [], "task_description": "In the JSON.", "prompt_template": "Here."}, None, None),
        "crlf": page(FULL | {"skill_name": "Pair", "query_types": ["multi_doc_compare"], "required_slots": ["compare_targets"]}).replace("\n", "\r\n"),
        "nofence": "# No metadata\n\n## Task Description\nx\n",
        "notjson": page("{not json"),
        "list": page([1, 2]),
        "fields": page({k: v for k, v in FULL.items() if k not in ("guardrails", "tool_chain")} | {"skill_name": "Fields"}),
        "blank": page(FULL | {"skill_name": " "}),
        "nosections": page(FULL | {"skill_name": "NoSections"}, None, " "),
        "twin1": page(FULL | {"skill_name": "Twin"}),
        "twin2": page(FULL | {"skill_name": "Twin"}),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.md").write_text(text, newline="")
    (tmp_path / "other.txt").write_text("not read")
    got = {r["path"].rsplit("/", 1)[1][:-3]: r for r in S.read_skills(spark, str(tmp_path)).collect()}
    reasons = {k: r["reasons"] for k, r in got.items()}
    assert reasons == {
        "good": [], "plain": [], "meta": [], "crlf": [], "nofence": ["no metadata"], "notjson": ["no object"], "list": ["no object"], "fields": ["missing tool_chain", "missing guardrails"],
        "blank": ["empty skill_name"], "nosections": ["empty task_description", "empty prompt_template"], "twin1": ["duplicate skill_name"], "twin2": ["duplicate skill_name"],
    }
    good = got["good"]
    assert (good["skill_name"], good["query_types"], good["tool_chain"], good["task_description"], good["prompt_template"]) == ("Facts", ["fact_lookup"], ["search", "answer"], "What it does.", "Answer {question}.")
    assert good["slot_schema"] == {"scope": '{"type":"string"}'} and got["meta"]["task_description"] == "In the JSON."

    # joined to questions: what the skill needs and the question lacks
    skills = S.read_skills(spark, str(tmp_path))
    assert {r["skill_name"] for r in S.usable(skills).collect()} == {"Facts", "Tables", "FromMeta", "Pair"}
    q = spark.createDataFrame([(1, "What is the notice period of it?"), (2, "short"), (3, "营业收入是多少"), (4, "compare A vs B"), (5, "compare them"), (6, "please summarize the whole report now")], "qid int, question string")
    q = q.withColumn("query_type", F.when(F.col("qid") <= 2, "fact_lookup").when(F.col("qid") == 3, "table_qa").when(F.col("qid") <= 5, "multi_doc_compare").otherwise("summarization"))
    found = {r["qid"]: (r["skill_name"], r["missing"]) for r in S.for_questions(q.withColumn("slots", Q.slots(F.col("question"), F.col("query_type"))), skills).collect()}
    assert found == {1: ("Facts", []), 2: ("Facts", ["scope"]), 3: ("Tables", []), 4: ("Pair", []), 5: ("Pair", ["compare_targets"]), 6: (None, None)}


def test_route_cases(spark):
    lines = ["| id | q | a | question | type | source | effective | refs |", "|---|---|---|---|---|---|---|---|", "| route_1 | x | y | And then? | follow_up | conversation_focus | What then of A | focus, turn_2 |", "| route_2 | | | New | new_rag_query | none | New | - |", "| text_1 | What | e | k1、k2 |", "no table", "| route_3 | too short |"]
    got = [tuple(r) for r in S.gold_routes(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("case_id").collect()]
    assert got == [("route_1", "And then?", "follow_up", "conversation_focus", "What then of A", ["focus", "turn_2"]), ("route_2", "New", "new_rag_query", "none", "New", [])]
    cases = [tuple(r) for r in pages.gold_cases(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert cases == [("text_1", "What", ["k1", "k2"], "fact_lookup")]
