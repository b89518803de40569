import zlib

import pytest

from brute import line_dedup as brute
from pyspark.sql import functions as F

from quillstone.llm import line_dedup

SCHEMA = "doc_id long, text string, n_chars long, keep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], SCHEMA)


def test_equals_brute_force_on_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digests(df).collect()}
    assert got == want


def test_frequent_line_over_many_tasks(spark):
    rows = [(i, f"a line that all have\nown line number {i}\n A LINE that all have \t\nshort") for i in range(300)]
    df = frame(spark, rows).repartition(7)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digests(df).collect()}
    assert got == brute(rows)
    kept = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(df).collect()}
    assert kept[0]["text"] == rows[0][1] and kept[5]["text"] == "own line number 5\nshort" and kept[5]["n_chars"] == 23 and kept[5]["keep"] == "x"


def test_borders_between_tasks():
    # tasks 0 to 2 hold one key; task 2 begins the next one, which goes on in task 3
    borders = [{"part": p, "h1": f, "h2": 0, "l1": x, "l2": 0, "doc": d, "leads": int(f == x)} for p, f, x, d in ((0, 1, 5, 9), (1, 5, 5, 11), (2, 5, 6, 30), (4, 6, 7, 40))]
    assert line_dedup._begun(borders) == {1: 9, 2: 9, 4: 30}


def test_edge_cases(spark):
    long = "\n".join(f"line number {i} of the long text" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "line number 7 of the long text"), (4, long), (5, "ünïcode lïne ÄÖ\n\n\n"), (6, "ünïcode lïne ÄÖ"), (6, "ünïcode lïne ÄÖ"), (None, "ünïcode lïne ÄÖ\nx")]
    got = sorted([(r["doc_id"] or 99, r["n_lines"], r["n_dropped"]) for r in line_dedup.digests(frame(spark, rows)).collect()])
    assert got == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 20000, 1), (5, 4, 0), (6, 1, 1), (6, 1, 1), (99, 2, 1)]
    assert line_dedup.digests(frame(spark, rows[:1]).limit(0)).count() == 0
    out = line_dedup.without_repeated_lines(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "n_chars", "keep"] and out.where("doc_id = 6").select(F.max("text")).first()[0] == ""


def test_bitmaps(spark):
    rows = [(1, "first shared line\nb"), (2, "b\nfirst shared line")]
    bits = line_dedup.keep_bitmaps(frame(spark, rows)).collect()
    assert len(bits) == 1 and bits[0]["n_dropped"] == 1 and len(zlib.decompress(bits[0]["keep"])) == 2
    assert line_dedup.kept_text(rows[1][1], bits[0]["keep"]) == "b"


def test_clashing_columns_and_ids_without_order(spark):
    names = ["doc", "tag", "keep", "row", "n_dropped", "__doc", "__keep", "pos"]
    df = spark.createDataFrame([(1, "a line that both have\nx", *names), (2, "a line that both have\ny", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(df).collect()}
    assert out[2]["text"] == "y" and out[1]["text"] == "a line that both have\nx" and all(out[i][n] == n for i in out for n in names)
    assert line_dedup.digests(df).count() == 2
    with pytest.raises(TypeError):
        line_dedup.digests(df.withColumn("doc_id", F.lit("a")))
