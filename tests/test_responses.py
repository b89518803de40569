from quillstone.operators import answers, engine, responses

CHUNKS = "chunk_id long, doc_id string, doc_source string, collection_name string, chunk_type string, content string, page_idx int, chunk_index int, heading_path string"


def test_responses(spark):
    """Answered, tables, asked back, refused after retries, and a filter by collection."""
    chunks = [
        (1, "d1", "/x/a.pdf", "c1", "text", "The warranty of the pump lasts two years and covers all parts", 1, 0, "Warranty"),
        (2, "d1", "/x/a.pdf", "c1", "text", "The warranty of the pump lasts two years and covers all parts", 1, 1, "Warranty"),
        (3, "d2", "/x/b.pdf", "c1", "table", "| 营业收入 | 2020 | 2021 |\n| --- | --- | --- |\n| 营业收入 合计 | 10 | 12 |", 4, 0, "Figures"),
        (5, "d3", "/x/c.pdf", "c2", "text", "the warranty of another pump is void", 0, 0, "Other"),
    ]
    corpus = spark.createDataFrame(chunks, CHUNKS).coalesce(1)
    asked = spark.createDataFrame([(1, "how long does the warranty of the pump last, page 2", None), (2, "2020 年 营业收入 是 多少", None), (3, "请对比一下吧各位", None), (4, "qqqq zzzz wwww vvvv", None), (5, "how long does the warranty of the pump last", "c2")], "qid long, question string, collection_name string").coalesce(1)
    got = {r["qid"]: r.asDict(recursive=True) for r in responses.respond(corpus, asked, engine.Config(top_k=2, retry_limit=2)).collect()}
    assert {q: r["decision"] for q, r in got.items()} == {1: "answer", 2: "answer", 3: "clarify", 4: "refuse", 5: "answer"}
    one = got[1]
    first = next(e for e in one["evidence"] if e["chunk_id"] == 1)
    assert one["answer"].startswith(answers.HEADS["fact"]) and first["doc_source"] == "a.pdf" and 2 not in {e["chunk_id"] for e in one["evidence"]}
    assert first["metadata_boost"] > 0.2 and one["citations"][0]["citation_id"] == "C1" and "warranty" in one["citations"][0]["quote"]
    assert one["trace"]["n_candidates"] >= 2 and one["trace"]["n_bm25"] >= 1 and one["trace"]["n_selected"] == len(one["evidence"]) and one["evaluation"]["grounding_score"] == 1.0
    assert got[2]["trace"]["n_tables"] == 1 and got[2]["evidence"][0]["table_boost"] >= 0.6
    assert got[3]["answer"].startswith(answers.CLARIFY) and got[3]["trace"]["missing"] and got[3]["trace"]["n_candidates"] == 0 and got[3]["evidence"] == []
    assert got[4]["trace"]["n_selected"] == 0 and got[4]["confidence"] == 0.0 and got[4]["evaluation"]["grounding_score"] == 0.0 and got[4]["trace"]["gate_reason"]
    assert {e["chunk_id"] for e in got[5]["evidence"]} == {5}
    stages = one["trace"]["stages"]
    assert [s["stage"] for s in stages if s["round"] < 2][:4] == ["understand", "retrieve", "rerank", "audit"] and stages[0]["rows"] == 5 and all(s["ms"] >= 0 for s in stages)
    assert next(s["top_score"] for s in stages if s["stage"] == "rerank") > 0
    # what is searched again has later rounds
    assert max(s["round"] for s in stages) == max(r["trace"]["rounds"] for r in got.values()) >= 2


def test_no_questions(spark):
    corpus = spark.createDataFrame([(1, "d", "s", "c", "text", "words", 0, 0, "")], CHUNKS)
    assert responses.respond(corpus, spark.createDataFrame([], "qid long, question string")).count() == 0
