import hashlib
import re

import pyarrow as pa
from brute import classes, line_dedup
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillstone.llm.queries import toxicity_model


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, before, sf))
        seen.append((name, before, after))
        if name != "packing":
            assert after.columns == columns
        before = after
    assert [n for n, _, _ in seen] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    name, given, kept = seen[2]
    want = classes([(r["doc_id"], r["text"]) for r in given.collect()], 5)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c}
    packed = seen[4][2]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in seen[3][2].collect()}


def test_registered():
    assert "pipeline" in entry.queries() and sum(q.startswith("op") for q in entry.queries()) == 10


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty, long and repeated texts, columns with clashing names, and an empty table go through all stages."""
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", None, "s", 9), (3, "twice the same text is here\nline", "en", "s", 32), (3, "twice the same text is here\nline", "en", "s", 32), (4, "word " * 60_000, "en", "s", 300_000), (5, "x" * 100_000, None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "keep", "doc", "tag", "row", "component_id", "kept", "__gone", "bucket"):
        docs = docs.withColumn(name, F.lit(name))
    for given in (docs, docs.limit(0)):
        before = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.cut(stage(spark, before, sf))
            assert after.columns == docs.columns, name
            before = after
        left = before.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
        assert sum(p["start"] == 0 for p in pieces) == len(left)
        if given is docs:
            assert {1, 2, None, 3, 4, 5} == {r["doc_id"] for r in left} and all(r["keep"] == "keep" for r in left)
        else:
            assert not left


def test_each_stage_does_its_own(spark, sf):
    """Stage by stage against plain code: scores, lines, classes and benchmark passages of what came in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity_model(spark, sf)
    kept = corpus_pipeline.drop_toxic(spark, docs, sf).collect()
    scores = model.score(pa.array([r["text"] for r in docs.collect()]))
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r, s in zip(docs.collect(), scores) if s < 0.5)
    lines = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf).collect()}
    want = line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[i][2] and r["n_chars"] == len(r["text"]) for i, r in lines.items())
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect()}
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 8]) for i in range(len(w) - 7)} for w in items]
    for r in docs.collect():
        w = re.findall(r"\w+", (r["text"] or "").lower())
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        if any(g and len(g & own) == len(g) for g in grams):
            assert r["doc_id"] in gone
