"""Operators against literals and plain restatements: chunker, contents, snippets, slots, candidates."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import answers, candidates, chunking, questions, rerank, retrieval


def test_recursive_parts_hold_the_text_within_the_size():
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a", "。", "\n", "\n\n", ", ", "长", "x" * 50, ". "]) for _ in range(rng.randint(1, 300)))
        size, overlap = rng.choice([(8, 0), (16, 4), (64, 20)])
        parts = chunking.split_recursively(text, size, overlap)
        assert all(len(p) <= 4 * size for p in parts)
        assert all(p in text for p in parts)
        if overlap == 0:
            assert "".join("".join(parts).split()) == "".join(text.split())
        else:
            # each part begins with the end of the one before it, of at most `overlap` tokens, or where that ended
            shared = [max((n for n in range(min(len(a), len(b)) + 1) if a.endswith(b[:n])), default=0) for a, b in zip(parts, parts[1:])]
            assert sum(map(len, parts)) - sum(shared) <= len(text)


def test_structured_chunks(spark):
    rows = [("d", 1, "title", "第一节 总则", 0, None, None), ("d", 2, "text", "hello world " * 40, 0, None, None), ("d", 3, "text", "second page text. " * 30, 1, None, None), ("d", 4, "table", "", 2, [["h", "k"], ["1", "2"], ["x" * 4000, "y"], ["3", "4"]], "table_1"), ("d", 5, "text", "after", 3, None, None), ("e", 1, "text", " ", 0, None, None), ("f", 1, "text", "no pages", -1, None, None)]
    b = spark.createDataFrame(rows, "doc string, place int, type string, text string, page_idx int, rows array<array<string>>, table_id string")
    got = chunking.structured_chunks(b, 60, 10, 60).orderBy("doc", "chunk_index").collect()
    d = [r for r in got if r["doc"] == "d"]
    assert [r["chunk_id"] for r in d] == [f"d_chunk_{i}" for i in range(len(d))] and {r["heading_path"] for r in d} == {"第一节 总则"}
    assert d[0]["content"] == "第一节 总则" and d[1]["content"].startswith("hello") and d[0]["page_range"] == "0-0" and d[-1]["content"] == "after" and d[-1]["page_range"] == "3-3"
    assert {r["page_range"] for r in d if "second" in r["content"]} <= {"0-1", "1-1"}
    t = [r for r in d if r["chunk_type"] == "table"]
    assert all(r["content"].startswith("| h | k |\n| --- | --- |") and r["table_header_text"] == "h | k" for r in t) and "| 3 | 4 |" in t[-1]["content"]
    assert t[0]["table_context_text"] and t[0]["table_context_text"] in " ".join(r["content"] for r in d if r["chunk_type"] == "text")
    assert [(r["doc"], r["page_range"], r["heading_path"]) for r in got if r["doc"] != "d"] == [("f", "-1--1", "front_matter")]


def test_oversize_rows_of_tables(spark):
    df = spark.createDataFrame([([["h", "k"], ["x" * 400, "y"], ["1", "2"]],), ([["h" * 400], ["1"]],), ([],), ([["h"]],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(chunking.split_table(F.col("rows"), 40)).collect()]
    assert all(p[0] == ["h", "k"] for p in got[0]) and [len(r[0]) for p in got[0] for r in p[1:]] [0] < 160
    assert got[1][0][1] == [chunking.OVERSIZE] and got[2] is None and got[3] == [[["h"]]]


def test_contents_and_queries(spark):
    rows = ['{"text":"a  b"}', '[{"content":"x"},"y z",{"value":"q"}]', "plain  text", '{"content":["u","v"]}', '{"b":1,"a":2}', None, '{"text":5,"value":"w"}', "{broken", "[1, 2"]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = [r[0] for r in df.select(X.normalize_content(F.col("c"))).collect()]
    assert got == ["a b", "x\ny z\nq", "plain text", "u\nv", '{"a":2,"b":1}', "", "w", "{broken", "[1, 2"]
    answers_ = ['text ```json\n{"queries":["a","b","a"]}\n``` end', '["x","y"] tail', "- one\n* two\n3. three\n4) four\n5. five", "none", None, '{"items":["i"]}']
    df = spark.createDataFrame([(r,) for r in answers_], "c string")
    assert [r[0] for r in df.select(X.json_queries(F.col("c"))).collect()] == [["a", "b"], ["x", "y"], ["one", "two", "three", "four"], [], [], ["i"]]
    cjk = spark.range(1).select(X.default_variants(F.lit("ROE是多少 2020"), 3), X.route_hint(F.lit("table_qa")), X.truncated(F.lit("abcdefgh"), 1)).first()
    assert cjk[0][0].startswith("roe 是多少") and cjk[1] == "指标 数值 单位 表头" and cjk[2] == "abcd"


def test_slots(spark):
    kind = "struct<years:array<string>,metric:string,period:string,target_statement:string,compare_targets:array<string>,scope:string>"
    df = spark.createDataFrame([((["2020"], "a", "", "", ["x"], ""), (["2021", "2020"], "", "", "t", ["y", "x"], "s")), (([], "", "", "", [], ""), ([], "", "in 1999", "", [], "")), (([], "", "", "", [], ""), None)], f"base {kind}, new {kind}")
    got = [r[0] for r in df.select(questions.merged_slots(F.col("base"), F.col("new"))).collect()]
    assert (got[0]["years"], got[0]["metric"], got[0]["period"], got[0]["target_statement"], got[0]["compare_targets"], got[0]["scope"]) == (["2020", "2021"], "a", "2020", "t", ["x", "y"], "s")
    assert got[1]["years"] == ["1999"] and got[1]["period"] == "in 1999" and got[2]["period"] == ""
    m = df.select(questions.merged_slots(F.col("base"), F.col("new")).alias("s"))
    assert [tuple(r) for r in m.select(questions.has_slots(F.col("s")), questions.retry_query(F.lit("q"), F.lit("other"), F.col("s"))).collect()][0] == (True, "q a 2020 t s x y 核心关键词 相关章节")


def test_snippet_windows():
    """The two-pointer sweep against trying each window."""
    rng = random.Random(2)
    for _ in range(200):
        length, size = rng.randint(1, 300), rng.randint(5, 80)
        places = [(a, min(length, a + rng.randint(1, 9)), rng.randrange(6)) for a in (rng.randrange(length) for _ in range(rng.randint(1, 25)))]
        sizes = {}
        places = [(a, a + sizes.setdefault(t, b - a), t) for a, b, t in places if a + sizes.get(t, b - a) <= length]
        if not places:
            continue

        def score(start):
            inside = {t: b - a for a, b, t in places if a < start + size and b > start}
            return 100 * len(inside) + sum(inside.values())

        starts = sorted({max(0, min((a + b) // 2 - size // 2, length - size)) for a, b, _ in places})
        best = max(starts, key=lambda s: (score(s), -s))
        assert score(answers.best_window(places, size, length)) == score(best)
    text = "x " * 900 + "the revenue of 2020 was high " + "y " * 900
    assert "revenue of 2020" in answers.snippet("revenue in 2020", text, False) and answers.snippet("nothing", "short", False) == "short"
    assert answers.snippet("revenue", "head | a\nrule\n" + text, True).startswith("head | a\nrule\n...")


def test_pair_and_search_texts(spark):
    df = spark.createDataFrame([("h", "t", None, "", "s", "raw", "c"), (None, "t", "t", None, "s", " ", "c  d")], "heading_path string, level1_title string, level2_title string, table_header_text string, doc_source string, raw_doc string, content string")
    got = df.select(candidates.pair_text(df), candidates.search_text(df)).collect()
    assert got[0][0] == "h\nt\ns\nraw" and got[1][0] == "t\ns\nc d" and "raw" in got[0][1] and got[1][1].endswith("c  d")
    key = spark.createDataFrame([(" a ", "t"), ("", "t"), (None, "t")], "c string, t string").select(candidates.candidate_key(F.col("c"), F.col("t"))).collect()
    assert key[0][0] == "a" and key[1][0] == key[2][0] and key[1][0].startswith("anon-")


def test_filled_up_and_many_questions(spark, monkeypatch):
    ranked = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcde")], "qid int, chunk_id string, rank int")
    kept = spark.createDataFrame([(1, "a"), (1, "d")], "qid int, chunk_id string")
    assert [(r["chunk_id"], r["place"]) for r in candidates.filled_up(kept, ranked, 4).orderBy("place").collect()] == [("a", 1), ("d", 2), ("b", 3), ("c", 4)]
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "chunk_id int, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "qid int, question_vector array<double>")
    whole = sorted(map(tuple, retrieval.dense(corpus, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, retrieval.dense(corpus, asked, 3).collect())) == whole


def test_embedder_keeps_order(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "chunk_id int, content string")
    got = {r["chunk_id"]: r["embedding"] for r in chunking.embedded(df, lambda texts: [[len(t), 1.0] for t in texts], dim=4).collect()}
    assert all(len(v) == 4 and abs(sum(x * x for x in v) - 1) < 1e-9 and abs(v[0] / v[1] - i) < 1e-9 for i, v in got.items())


@pytest.fixture
def one_task(spark):
    """Tiny tables: one partition, and no plan that is made anew stage by stage."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_question_path(spark, one_task):
    """Mixed types end to end: answers by template, a table question, a clarification, a refusal."""
    from quillstone.operators import engine

    chunks = [
        (1, "d1", "/x/a.pdf", "text", "The warranty of the pump lasts two years and covers all parts", 1, 0),
        (2, "d1", "/x/a.pdf", "text", "The warranty of the pump lasts two years and covers all parts", 1, 1),
        (3, "d2", "/x/b.pdf", "table", "| 营业收入 | 2020 | 2021 |\n| --- | --- | --- |\n| 营业收入 合计 | 10 | 12 |", 4, 0),
        (5, "d3", "/x/c.pdf", "text", "nothing in here is of use", 0, 0),
    ]
    corpus = spark.createDataFrame(chunks, "chunk_id long, doc_id string, doc_source string, chunk_type string, content string, page_idx int, chunk_index int").coalesce(1)
    asked = spark.createDataFrame([(1, "how long does the warranty of the pump last"), (2, "2020 年 营业收入 是 多少"), (3, "请对比一下吧各位"), (4, "qqqq zzzz wwww vvvv")], "qid long, question string").coalesce(1)
    held = []
    got = {r["qid"]: r for r in engine.asked_and_answered(corpus, asked, engine.Config(top_k=2, retry_limit=0), held).collect()}
    assert got.keys() == {1, 2, 3, 4}
    assert "warranty of the pump" in got[1]["answer"] and got[1]["answer"].count("warranty") == 1 and got[1]["answer"].startswith(answers.HEADS["fact"])
    assert got[2]["query_type"] == "table_qa" and got[2]["answer"].startswith(answers.HEADS["table"]) and "合计" in got[2]["answer"]
    assert got[3]["decision"] == "clarify" and got[3]["answer"].startswith(answers.CLARIFY)
    assert got[4]["decision"] == "refuse" and got[4]["confidence"] == 0.0
    for df in held:
        df.unpersist()


def test_pair_models_that_fail(spark, one_task):
    """Without scores for each row a question ranks by recall."""
    rows = spark.createDataFrame([(1, i, "q", t, s) for i, (t, s) in enumerate([("a", 0.9), ("of use", 0.5), ("b", 0.1)])], "qid long, chunk_id long, question string, content string, retrieval_score double").coalesce(1)

    def broken(questions, texts):
        raise ValueError("no model")

    for scorer, source, first in ((broken, "hybrid_recall_score", 0), (lambda q, t: [1.0], "hybrid_recall_score", 0), (lambda q, t: [float("of use" in x) for x in t], "model_score", 1)):
        got = rerank.model_scores(rows, scorer, 3).orderBy("place").collect()
        assert {r["score_source"] for r in got} == {source} and got[0]["chunk_id"] == first


def test_entities(spark):
    from quillstone.sources.pages import unescape

    rows = ["&eacute;&#8217;&#x41; &amp;lt; &nbsp;|&copy;&unknown; & &;", "plain", None, "&#55296;&#0;&#1114112;", "&#128512;x"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "c string").select(unescape(F.col("c"))).collect()]
    assert got == ["é’A &lt;  |©&unknown; & &;", "plain", None, "&#55296;&#0;&#1114112;", "😀x"]


def _plainly(text, size, overlap, separators=chunking.SEPARATORS):
    """The splitter part by part, as strings."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep = separators[at]
    parts = [x for x in re.split(f"(?={re.escape(sep)})", text) if x] if sep else list(text)

    def merged(parts):
        out, run, length = [], [], 0
        for part in parts:
            if run and length + len(part) > 4 * size:
                out.append("".join(run))
                while run and (length > 4 * overlap or length + len(part) > 4 * size):
                    length -= len(run.pop(0))
            run.append(part)
            length += len(part)
        return out + ["".join(run)] if run else out

    out, run = [], []
    for part in parts:
        if len(part) <= 4 * size or not sep:
            run.append(part)
        else:
            out += merged(run) + _plainly(part, size, overlap, separators[at + 1 :])
            run = []
    return [x for x in out + merged(run) if x.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n 。.,;é", max_size=120), st.integers(1, 6), st.integers(0, 4))
def test_offsets_equal_the_splitter_by_strings(text, size, overlap):
    if text:
        assert chunking.split_recursively(text, size, overlap) == _plainly(text, size, overlap)
        assert all(0 <= a < b <= len(text) and b - a <= 4 * size for a, b in chunking.split_offsets(text, size, overlap))


def test_pages_of_texts_that_occur_twice(spark):
    """The same paragraph on three pages: each part has the page it lies on."""
    para = "the same words stand on every page of this document here."
    blocks = [("d", i, "text", para, i + 1, None, None) for i in range(3)] + [("d", 3, "text", "the end", None, None, None), ("e", 0, "text", para, 7, None, None)]
    b = spark.createDataFrame(blocks, "doc string, place int, type string, text string, page_idx int, rows array<array<string>>, table_id string")
    got = [(r["doc"], r["content"], r["page_range"]) for r in chunking.structured_chunks(b, 16, 0, 60).orderBy("doc", "chunk_index").collect()]
    assert got == [("d", para, "1-1"), ("d", para, "2-2"), ("d", f"{para}", "3-3"), ("d", "the end", "-1--1"), ("e", para, "7-7")]


def test_value_metrics(spark):
    """Metrics of `how much` questions: requests, dates, marks and shared endings go."""
    cases = {
        "2021年营业收入是多少？": ["营业收入"],
        "请问在2020年度的净利润为多少": ["净利润"],
        "查询 2019年上半年 的 研发费用 有多少，其中 管理费用 达到多少": ["研发费用", "管理费用"],
        "营业收入和净利润分别是多少": ["营业收入和净利润"],
        "总资产的分别多少；总资产多少": ["总资产"],
        "和利润多少": ["利润"],
        "2020年多少": [],
        "多少": [],
        "How much is it": [],
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    got = {r["q"]: r["m"] for r in df.select("q", questions.value_metrics(F.col("q")).alias("m")).collect()}
    assert got == cases
