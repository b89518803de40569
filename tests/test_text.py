"""Text functions, questions, headings, tables and stores on literals."""

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.vectors import cosine, fitted
from quillstone.operators import chunking, evidence, questions, rerank, sessions, store
from quillstone.sources import pages
from quillstone.streaming import indexing


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_whitespace(spark):
    texts = ["a\r\nb\r\n\r\nc", "x 　 y", " \t a  b \n\n  c ", None, ""]
    assert values(spark, texts, X.normalize_whitespace) == ["a\nb\nc", "x y", "a b\nc", "", ""]
    assert values(spark, ["a \n b", "a\x0bb\t\tc"], lambda c: X.normalize_whitespace(c, False)) == ["a   b", "a b c"]


def test_tokens(spark):
    assert values(spark, ["营收", "净利润", "Café a_1", "现金流量 x", None], X.coarse_tokens) == [["营收", "营收"], ["净利润", "净利", "利润", "净利润"], ["caf", "a_1"], ["现金流量", "现金", "金流", "流量", "现金流", "金流量", "x"], []]
    assert values(spark, ["现金流量 ab", "利润"], X.long_gram_tokens) == [["现金", "金流", "流量", "现金流", "金流量", "现金流量", "现金流量", "ab"], ["利润"]]
    assert values(spark, ["利x", "!?"], X.char_tokens) == [["利", "x"], ["!", "?"]]
    assert values(spark, ["Éa b-b", ""], X.word_set) == [["éa", "b"], []]


def test_facts(spark):
    assert values(spark, ["page 12", "top 5", "第3页", "none", None], X.page_hint) == [12, 5, 3, None, None]
    assert values(spark, ["2019年 1999 3019", ""], X.years) == [["2019", "1999"], []]
    assert values(spark, ["abcde", "", None], X.token_count) == [2, 1, 1]
    assert values(spark, ["a/b\\c.pdf", "x"], X.base_name) == ["c.pdf", "x"]


def test_headings(spark):
    assert values(spark, ["第一节 概况", "一、收入", "（二）成本", "1. 条款", "正文", ""], X.heading_level) == [1, 2, 3, 0, 0, 0]
    blocks = spark.createDataFrame([(1, i, "title" if t[0] in "第一二（" else "text", t) for i, t in enumerate(["第一节 甲", "一、乙", "（一）丙", "正文", "二、丁", "后文"])], "doc int, place int, type string, text string")
    got = [r["heading_path"] for r in chunking.with_headings(blocks).orderBy("place").collect()]
    assert got[3] == "第一节 甲 > 一、乙 > （一）丙" and got[5] == "第一节 甲 > 二、丁"
    runs = chunking.text_runs(chunking.with_headings(blocks)).orderBy("first_place").collect()
    assert [r["text"] for r in runs] == ["正文", "后文"]


def test_questions(spark):
    asked = ["甲和乙对比", "请生成报告", "出处在哪里", "公司的法定代表人是谁", "2020年营业收入是多少", "请总结这一章", "这个怎么办呢", "嗯", "what is it about"]
    kinds = ["multi_doc_compare", "report_generation", "citation_locate", "fact_lookup", "table_qa", "summarization", "ambiguous_query", "ambiguous_query", "fact_lookup"]
    assert values(spark, asked, questions.query_type) == kinds
    s = values(spark, ["2020年营业收入是多少？", "A vs B"], lambda c: questions.slots(c, questions.query_type(c)))
    assert s[0]["metric"] == "营业收入" and s[0]["period"] == "2020" and s[1]["compare_targets"] == ["a", "b"]
    v = values(spark, ["请问 revenue 2020?"], lambda c: X.variants(c, F.lit("table_qa")))[0]
    assert v[0] == "请问 revenue 2020?" and "revenue 2020" in v and len(v) <= 4


def test_tables(spark):
    html = "<table><tr><th>A&amp;B<th>C<tr><td>1<td> <tr><td> <td></table>"
    assert values(spark, [html], pages.html_tables) == [[[["A&B", "C"], ["1", ""]]]]
    df = spark.range(1).select(F.array(F.array(F.lit("h"), F.lit("k")), F.array(F.lit("1")), F.array(F.lit(""))).alias("r"))
    assert df.select(chunking.markdown(F.col("r"))).first()[0] == "| h | k |\n| --- | --- |\n| 1 |  |"
    big = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.array(F.repeat(i.cast("string"), 40))).alias("r"))
    parts = big.select(chunking.split_table(F.col("r"), 25)).first()[0]
    assert all(p[0] == ["0" * 40] for p in parts) and sum(len(p) - 1 for p in parts) == 9


def test_payloads(spark):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(f"id int, payload {pages.PAYLOAD}")
    line = lambda t: [([(t, "text", None)],)]
    info = [(1, None, [(0, "text", None, line("later"), None, None)]), (0, None, [(1, "odd", None, line("second"), None, None), (0, "title", None, line("first"), None, None), (2, "table", None, [([(None, "table", "<table><tr><td>x</table>")],)], None, None), (3, "text", None, line(" "), None, None)])]
    df = spark.createDataFrame([(1, ("s", "p", info))], schema)
    got = pages.payload_blocks(df, "id").orderBy("place").collect()
    assert [(r["type"], r["text"]) for r in got] == [("title", "first"), ("text", "second"), ("table", ""), ("text", "later")]
    assert got[2]["rows"] == [["x"]] and got[2]["table_id"] == "table_1"


def test_rerank(spark):
    df = spark.createDataFrame([(1, 1, 0.9, "the same text of words here"), (1, 2, 0.8, "The same text, of words here!"), (1, 3, 0.7, "other things"), (1, 4, 0.6, "the same text of words here x")], "qid int, chunk_id int, retrieval_score double, content string")
    assert sorted(r["chunk_id"] for r in rerank.deduplicated(df).collect()) == [1, 3]
    scored = rerank.model_scores(df.withColumn("question", F.lit("q")), lambda q, t: [float(len(x)) for x in t], 2)
    assert [r["chunk_id"] for r in scored.orderBy("place").collect()] == [2, 4]
    s = {k: v for k, v in zip(["grounding_score", "overall_score"], spark.range(1).select(*[evidence.evaluation(F.lit(""), F.lit("answer"), F.lit(0), F.lit(0))[k] for k in ("grounding_score", "overall_score")]).first())}
    assert s == {"grounding_score": 0.0, "overall_score": 0.0}


def test_vectors(spark):
    df = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    r = df.select(fitted(F.col("a"), 3).alias("f"), cosine(F.col("a"), F.col("z")).alias("c"), cosine(F.col("a"), F.col("a")).alias("o")).first()
    assert [round(x, 6) for x in r["f"]] == [0.6, 0.8, 0.0] and r["c"] == 0 and abs(r["o"] - 1) < 1e-9


def test_sessions_and_store(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (2, 0, "assistant", "e")], "session_id int, place int, role string, content string")
    assert [(r["question"], r["answer_summary"]) for r in sessions.turns(m).collect()] == [("b", "c")]
    s = spark.createDataFrame([("a", "c1", 1), ("b", "c1", 2)], "session_id string, collection_name string, updated_at int")
    new = spark.createDataFrame([("a", " ", 5), ("z", "", 6)], "session_id string, collection_name string, updated_at int")
    assert {tuple(r) for r in store.touched(s, new).collect()} == {("a", "c1", 5), ("b", "c1", 2), ("z", "default", 6)}
    merged = spark.range(1).select(store.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).first()[0]
    assert merged == {"a": "1", "b": "3"}


def test_stream_equals_batch(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "n_chars")
    for i, part in enumerate((d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0").withColumn("source", F.lit("new")), d.where("doc_id % 5 = 0"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    import glob
    import os
    import shutil

    os.makedirs(f"{tmp_path}/flat")
    for i, f in enumerate(sorted(glob.glob(f"{tmp_path}/in/*/part-*.parquet"), key=lambda f: f.split("/in/")[1])):
        shutil.copy(f, f"{tmp_path}/flat/{i}.parquet")
        os.utime(f"{tmp_path}/flat/{i}.parquet", (1000 + i, 1000 + i))
    q = indexing.stream_upserts(spark, f"{tmp_path}/flat", "doc_id long, source string, n_chars long", f"{tmp_path}/out", f"{tmp_path}/ck", ["doc_id"], "n_chars")
    q.awaitTermination(120)
    got = {r["doc_id"]: r["source"] for r in indexing.current(spark, f"{tmp_path}/out").collect()}
    want = {r["doc_id"]: r["source"] for r in d.collect()}
    for i in want:
        if i % 5 == 0:
            assert got[i] == want[i]
        elif i % 3 == 0:
            assert got[i] == "new"
        elif i % 2 == 0:
            assert got[i] == want[i]
        else:
            assert i not in got


def test_capitals_letter_by_letter(spark):
    """As SQL's upper has them: the JVM makes two letters of some."""
    import duckdb

    texts = ["stra\u00dfe", "\ufb01n \u0149 \u1f80\u1fb3", "Abc \u00e9\u00ff\u01c6 \U00010428 1_", "", None, *map(chr, [*range(1, 0xD800), *range(0xE000, 0x10400)])]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.upper_each(F.col("t"))).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS t", [texts])
    assert [r[0] for r in got] == [r[0] for r in con.execute("SELECT upper(t) FROM t").fetchall()]
