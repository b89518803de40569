"""Stored indexes, bucketed tables and set joins against plain code and the unstored operators."""

import os

import pytest
from pyspark.sql import functions as F

from quillstone.functions.vectors import cosine
from quillstone.operators import bucket_store, nearest, retrieval, set_join, text_index, vector_index
from quillstone.plans.search import asked, corpus, vectors
from quillstone.streaming import indexing


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- vectors ------------------------------------------------------------------


def test_vector_index(spark, sf, tmp_path):
    v, _ = vectors(spark, sf)
    q = v.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), F.col("vector").alias("question_vector"))
    exact = retrieval.dense(v, q, 10)
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(5)) > 0
    index = vector_index.build(v.where(part), str(tmp_path / "ix"))
    index = vector_index.add(index, v.where(~part))
    assert index.vectors.count() == v.count() and 1 <= index.probes < len(index.centroids)
    assert rows(vector_index.search_exact(index, q, 10)) == rows(exact.select("qid", "chunk_id", "dense_score", "rank"))
    found = vector_index.search(index, q, 10)
    assert vector_index.recall(found, exact) >= 0.9
    # what is found has its exact score, and fewer cells find less
    assert found.join(v, "chunk_id").join(q, "qid").count() == found.count()
    assert vector_index.recall(vector_index.search(index, q, 10, probes=2), exact) < vector_index.recall(found, exact)
    # only the files of the cells are read
    one = q.where("qid = 0")
    cells = {r["cell"] for r in vector_index.probed(index, one, 2).collect()}
    read = {int(f.split("/cell=")[1].split("/")[0]) for f in vector_index.search(index, one, 10, probes=2).inputFiles() if "/cell=" in f}
    plan = vector_index.search(index, one, 10, probes=2)._jdf.queryExecution().toString()
    assert len(cells) == 2 and read <= set(range(len(index.centroids))) and "PartitionFilters: [cell#" in plan


def test_vectors_that_are_odd(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 64)
    monkeypatch.setattr(nearest, "SCORES", 4)
    data = [(f"c{i:03}", [1.0, 0.0] if i < 60 else [float(i % 7), float(i % 5) - 2], "a" if i % 2 else None) for i in range(90)]
    data += [("zero", [0.0, 0.0], "a"), ("none", None, "a"), ("long", [1.0, 2.0, 3.0], "a")]
    v = spark.createDataFrame(data, "chunk_id string, vector array<float>, kind string")
    q = spark.createDataFrame([(1, [2.0, 0.0], "a"), (2, [0.5, 0.5], None), (3, [0.0, 0.0], None), (4, None, None), (5, [-1.0, 0.1], "zzz")], "qid int, question_vector array<double>, kind string")
    index = vector_index.build(v, str(tmp_path / "ix"), cells=4)
    got = {(r["qid"], r["rank"]): (r["chunk_id"], r["dense_score"]) for r in vector_index.search_exact(index, q, 3, filters=("kind",)).collect()}
    assert [got[1, i][0] for i in (1, 2, 3)] == ["c001", "c003", "c005"]  # equal scores by id, of its own kind
    assert got[2, 1][1] >= got[2, 2][1] >= got[2, 3][1] > 0.9 and got[3, 1] == ("c000", 0.0)
    assert {q for q, _ in got} == {1, 2, 3}
    assert vector_index.search_exact(index, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(v.limit(0), str(tmp_path / "none"))


def test_every_vector_is_scored_where_it_is(spark):
    """No join of pairs: a plan that has one grows with questions times vectors, on the JVM and in a shuffle."""
    data = [(i, [float(i % 7), float(i % 5) - 2]) for i in range(80)] + [(100, [0.0, 0.0]), (101, None), (102, [1.0, None]), (103, [1.0, 2.0, 3.0]), (104, [-1.0, 0.0])]
    v = spark.createDataFrame(data, "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0])], "qid long, question_vector array<double>")
    pairs = v.crossJoin(q).select("qid", "chunk_id", F.round(F.coalesce(cosine(F.col("vector"), F.col("question_vector")), F.lit(0.0)), 6).alias("dense_score"))
    for k in (4, 90):
        found = retrieval.dense(v, q, k)
        assert rows(found) == rows(retrieval.top(pairs, k, F.col("dense_score"), "qid"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    longer = spark.createDataFrame([(9, [2.0, 4.0, 6.0])], q.schema)
    assert [tuple(r) for r in retrieval.dense(v, q.unionByName(longer), 2).where("qid = 9").orderBy("rank").collect()] == [(9, 103, 1.0, 1), (9, 0, 0.0, 2)]
    none = q.where("qid = 2")
    assert [tuple(r) for r in retrieval.dense(v, none, 2).collect()] == [(2, 0, 0.0, 1), (2, 1, 0.0, 2)]
    assert retrieval.dense(v, q.limit(0), 2).count() == 0


# ---- BM25 ---------------------------------------------------------------------


def test_bm25_tasks_grow_with_the_corpus(spark, sf, monkeypatch):
    """A task's share of the scores is bounded, and no pair of question and chunk is shuffled but its k best."""
    c, q = corpus(spark, sf), asked(spark, sf)
    plain, by_source = rows(retrieval.bm25(c, q, 5)), rows(retrieval.bm25(c, q, 5, keys=("collection_name",)))
    assert len(plain) == 5 * q.count() and len(by_source) > len(plain)
    seen = []
    kept = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df: seen.append(df) or kept(df))
    monkeypatch.setattr(retrieval, "TASK_SCORES", q.count() * 10)
    monkeypatch.setattr(retrieval, "TASK_TOKENS", 1 << 40)
    assert rows(retrieval.bm25(c, q, 5)) == plain
    plan = seen[-1]._jdf.queryExecution().toString()
    assert f"hashpartitioning(chunk_id#" in plan and f", {c.count() // 10})" in plan
    physical = plan[plan.index("== Physical Plan =="):]
    # after the chunks are dealt out the k best of each question are the one thing that moves
    assert physical.count("Exchange hashpartitioning(chunk_id") == 1 and physical.count("Exchange hashpartitioning(qid") == 1
    assert not [line for line in physical.splitlines() if "Exchange hashpartitioning" in line and "qid" in line and "chunk_id" in line.split("hashpartitioning(")[1].split(")")[0]]
    assert rows(retrieval.bm25(c, q, 5, keys=("collection_name",))) == by_source
    assert retrieval.bm25(c.limit(0), q, 5).count() == 0 and retrieval.bm25(c, q.limit(0), 5).count() == 0


def test_text_index_grows_and_shrinks(spark, sf, tmp_path, monkeypatch):
    c, q = corpus(spark, sf), asked(spark, sf)
    c = c.unionByName(spark.createDataFrame([(5000, "src0", "en", ""), (5001, "src1", "en", None)], c.schema))
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0
    some = c.where("chunk_id % 3 = 0")
    index = text_index.add(text_index.build(c.where(half), str(tmp_path / "all")), c.where(~half))
    for seeds, direct in ((1, 0), (50, 0), (50, 1 << 25)):
        monkeypatch.setattr(text_index, "SEEDS", seeds)
        monkeypatch.setattr(text_index, "DIRECT", direct)
        assert rows(text_index.search(index, q, 5)) == rows(retrieval.bm25(c, q, 5))
    monkeypatch.setattr(text_index, "DIRECT", 0)
    less = text_index.remove(index, some)
    rest = c.where("chunk_id % 3 <> 0")
    assert rows(text_index.search(less, q, 5)) == rows(retrieval.bm25(rest, q, 5))
    again = text_index.add(less, some)
    assert rows(text_index.search(again, q, 5, k1=1.2, b=0.5)) == rows(retrieval.bm25(c, q, 5, k1=1.2, b=0.5))
    assert rows(text_index.search(text_index.load(spark, str(tmp_path / "all")), q, 5)) == rows(retrieval.bm25(c, q, 5))


def test_bounds_prune(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "DIRECT", 0)
    # a common and a rare word: chunks with the common word alone are no candidates
    texts = [(i, "common " * (1 + i % 3) + ("rare" if i < 20 else f"w{i}")) for i in range(400)]
    c = spark.createDataFrame(texts, "chunk_id int, content string")
    q = spark.createDataFrame([(1, "common rare"), (2, "nothing of it")], "qid int, question string")
    index = text_index.build(c, str(tmp_path / "ix"))
    seen = []
    kept, text_index.written = text_index.written, lambda df: seen.append(kept(df)) or seen[-1]
    try:
        got = rows(text_index.search(index, q, 10))
    finally:
        text_index.written = kept
    assert got == rows(retrieval.bm25(c, q, 10)) and len(got) == 10
    candidates = next(df for df in seen if df.columns == ["qid", "chunk_id", "part"])
    assert candidates.count() == 20


# ---- bucketed stores ----------------------------------------------------------

CHUNKS = "collection_name string, doc_source string, chunk_id long, doc_id string, doc_hash string, indexed_at int, content string"


def tree(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/bucket=" in d}


def test_a_change_rewrites_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    all_rows = spark.range(500).select("id", F.lit(1).alias("v"), F.lit("old").alias("x"))
    store = bucket_store.create(spark, path, all_rows.schema, ["id"], buckets=16)
    assert store.read().count() == 0
    assert len(store.upsert(all_rows, F.col("v"))) == 16
    before = tree(path)
    one = spark.createDataFrame([(7, 2, "new"), (7, 1, "stale")], all_rows.schema)
    assert len(store.upsert(one, F.col("v"), tag="b1")) == 1
    new = tree(path) - before
    assert len({os.path.dirname(f) for f in new}) == 1 and before <= tree(path)
    got = {r["id"]: r["x"] for r in store.read().collect()}
    assert len(got) == 500 and got[7] == "new" and got[8] == "old"
    # repeated: nothing happens; the table before the change is still there
    after = tree(path)
    assert store.upsert(one, F.col("v"), tag="b1") == [] and tree(path) == after
    assert store.read(1).where("id = 7").first()["x"] == "old"
    # a change that fails leaves the table as it was
    with pytest.raises(Exception, match="boom|BOOM"):
        store.change(one, lambda stored, new: stored.withColumn("x", F.raise_error(F.lit("boom"))))
    assert store.manifest().number == 2 and store.read().count() == 500
    # rows of a bucket all go
    gone = store.read().where(store.bucket() == store.touched(one)[0]).select("id")
    n = gone.count()
    store.delete(gone)
    assert store.read().count() == 500 - n and len(store.manifest().versions) == 15
    assert store.expire(keep=1) > 0
    assert store.read().count() == 500 - n and len(store.manifests()) == 1
    assert bucket_store.load(spark, path).keys == ("id",)
    store.delete(store.read().select("id"))
    assert store.read().count() == 0 and store.manifest().versions == {}


def chunk(source, i, h, at, text):
    return ("c", source, i, source, h, at, text)


def test_incremental_plan_is_carried_out(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda found: spark.createDataFrame(found, CHUNKS)
    store = bucket_store.create(spark, path, make([]).schema, ["collection_name", "doc_source", "chunk_id"], by=bucket_store.SOURCE, buckets=8)
    first = make([chunk(s, i, "h1", 1, f"{s}{i}") for s in "abc" for i in range(3)])
    assert {r["action"] for r in store.index(first).collect()} == {"insert"}
    before = tree(path)
    # a is unchanged, b has two chunks instead of three, d is new
    second = make([chunk("a", i, "h1", 2, "not read") for i in range(3)] + [chunk("b", i, "h2", 2, "changed") for i in range(2)] + [chunk("d", 0, "h1", 2, "d0")])
    assert {r["doc_source"]: r["action"] for r in store.index(second).collect()} == {"a": "skip", "b": "replace", "d": "insert"}
    got = {(r["doc_source"], r["chunk_id"]): r["content"] for r in store.read().collect()}
    assert got == {("a", 0): "a0", ("a", 1): "a1", ("a", 2): "a2", ("b", 0): "changed", ("b", 1): "changed", ("c", 0): "c0", ("c", 1): "c1", ("c", 2): "c2", ("d", 0): "d0"}
    after = tree(path)
    assert {r["action"] for r in store.index(second).collect()} == {"skip"} and tree(path) == after and before < after
    assert {r["action"] for r in store.index(second, force=True).collect()} == {"replace"}
    with pytest.raises(ValueError):
        bucket_store.create(spark, str(tmp_path / "u"), first.schema, ["chunk_id"]).index(first)


def test_stream_of_sources_equals_the_batches(spark, tmp_path):
    for i, (h, sources) in enumerate((("h1", "abc"), ("h2", "ad"))):
        spark.createDataFrame([chunk(s, n, h, i, f"{s}{n}{h}") for s in sources for n in range(2 + i)], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = indexing.stream_index(spark, str(tmp_path / "in"), CHUNKS, str(tmp_path / "out"), str(tmp_path / "ck"), buckets=4)
        q.awaitTermination()
        got = rows(indexing.current(spark, str(tmp_path / "out")).select("doc_source", "chunk_id", "content"))
        assert got == [(s, n, f"{s}{n}{h}") for s, h, k in (("a", "h2", 3), ("b", "h1", 2), ("c", "h1", 2), ("d", "h2", 3)) for n in range(k)]
    assert indexing.current(spark, str(tmp_path / "nothing")) is None


# ---- set joins ------------------------------------------------------------------


def brute_links(texts, percent):
    sets = {i: frozenset((t or "").lower().split()) for i, t in texts}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    ids, out = sorted(first.values()), []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, least = len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))
            if least and 100 * both >= percent * least:
                out.append((a, b, both, len(sets[a]), len(sets[b]), round(both / least, 8)))
    return sorted(out), {i: first[s] for i, s in sets.items()}


@pytest.mark.parametrize("percent", [90, 60, 100])
def test_set_join_equals_brute_force(spark, percent):
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[(i * 7 + j * (1 + i % 3)) % 60] for j in range(1 + (i * 5) % 25))) for i in range(160)]
    texts += [(200 + i, "same words in all of these copies") for i in range(30)] + [(300, "copies these of all in words same"), (301, None), (302, ""), (303, "same"), (304, "same words in all of these copies and more")]
    pairs, members = set_join.links(spark.createDataFrame(texts, "chunk_id long, content string"), percent)
    want, own = brute_links(texts, percent)
    assert rows(pairs) == sorted(want, key=repr)
    assert {r["chunk_id"]: r["class_id"] for r in members.collect()} == own
    counts = {r["chunk_id"]: r["n_links"] for r in set_join.link_counts(pairs, members).collect()}
    assert len(counts) == len(texts) and counts[301] == counts[302] == 0 and counts[303] >= 31 + 1


def test_fallback_moves_the_best_alone(spark, sf, monkeypatch):
    """Of the pairs of query and chunk, the best of each query and task are shuffled and no others."""
    from quillstone.operators import fallback
    from quillstone.plans import stored

    chunks = stored._fallback_chunks(spark, sf)
    q = asked(spark, sf).select("qid", F.lit("table_qa").alias("query_type"), F.col("question").alias("query"))
    seen = []
    kept = fallback.written
    monkeypatch.setattr(fallback, "written", lambda df: seen.append(df) or kept(df))
    found = fallback.scored(chunks, q, 2)
    assert found.groupBy("qid").count().where("count > 8").count() == 0 and found.count() > 0
    plan = seen[-1]._jdf.queryExecution().toString()
    moved = [line for line in plan[plan.index("== Physical Plan =="):].splitlines() if "Exchange hashpartitioning" in line]
    assert [line.split("hashpartitioning(")[1].split("#")[0] for line in moved if "qid" in line] == ["qid"] and not [line for line in moved if "d_size#" in line]


def test_set_join_moves_links_alone(spark, sf, monkeypatch):
    """Candidates stay in the task of a block: what is written of pairs are links, and there are several blocks and parts."""
    seen = []
    kept = set_join.written
    monkeypatch.setattr(set_join, "written", lambda df: seen.append(kept(df)) or seen[-1])
    whole = rows(set_join.links(corpus(spark, sf))[0])
    monkeypatch.setattr(set_join, "BLOCK_TOKENS", 3000)
    assert rows(set_join.links(corpus(spark, sf))[0]) == whole
    assert [df.count() for df in seen if {"a", "b"} <= set(df.columns)] == [len(whole)] * 2


@pytest.mark.parametrize("postings, at_once", [(0, 5), (4096, 1 << 22)])
def test_block_of_larger_sets(monkeypatch, postings, at_once):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(set_join, "POSTINGS", postings)
    monkeypatch.setattr(set_join, "TOKENS_AT_ONCE", at_once)
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 32 if i % 9 == 0 else 40, 1 + i % 30)).astype(np.uint32) for i in range(120)]
    assert all((set_join.unpacked(set_join.packed(x)) == x).all() for x in sets)
    block = set_join._Block([pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array([len(x) for x in sets], pa.int32()), pa.array([set_join.packed(x) for x in sets])], ["id", "n", "data"])])
    for x in sets:
        common = [len(np.intersect1d(x, y)) for y in sets]
        at, n = block.partners(x, 70)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == {i: c for i, c in enumerate(common) if 100 * c >= 70 * len(x) and len(sets[i]) >= len(x)}


def test_set_join_neither_deals_out_nor_repeats_sets(spark, sf, monkeypatch):
    """Blocks come to the sets, so sets are in no shuffle of a block; tokens meet their numbers without a shuffle, or above VOCABULARY with one, for the same links."""
    seen, met = [], []
    kept, run = set_join.written, set_join._met
    monkeypatch.setattr(set_join, "written", lambda df: seen.append(df) or kept(df))
    monkeypatch.setattr(set_join, "_met", lambda *a: met.append(a) or run(*a))
    monkeypatch.setattr(set_join, "BLOCK_TOKENS", 8_000)
    whole = rows(set_join.links(corpus(spark, sf))[0])
    assert len(met) > 2 and len(whole) > 10
    plans = [df._jdf.queryExecution().toString() for df in seen]
    plans = [p[p.index("== Physical Plan ==") :] for p in plans]
    assert not [p for p in plans if "Exchange" in p and ("block" in p or "task" in p)]
    ranked = next(p for p, df in zip(plans, seen) if "prefix" in df.columns)
    assert "Generate explode" not in ranked and not [line for line in ranked.splitlines() if "Exchange hashpartitioning(term" in line]
    monkeypatch.setattr(set_join, "VOCABULARY", 10)
    assert rows(set_join.links(corpus(spark, sf))[0]) == whole


def test_fallback_scores_chunks_where_they_are(spark, sf, monkeypatch):
    """Pairs of query and chunk are in no shuffle; blocks of queries and small matrices give the same, and so do rows that share an id as one join of them all does."""
    from quillstone.operators import fallback
    from quillstone.plans import stored

    chunks = stored._fallback_chunks(spark, sf).where("chunk_id < 80")
    q = asked(spark, sf).where("qid < 20").select("qid", F.lit("table_qa").alias("query_type"), F.explode(F.array("question", F.concat("question", F.lit(" en 3")))).alias("query"))
    seen, kept = [], fallback.written
    monkeypatch.setattr(fallback, "written", lambda df: seen.append(df) or kept(df))
    whole = rows(fallback.scored(chunks, q, 2))
    plan = seen[-1]._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "hashpartitioning(chunk_id" not in plan[plan.index("== Physical Plan ==") :]
    monkeypatch.setattr(fallback, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(fallback, "CELLS", 3000)
    assert rows(fallback.scored(chunks, q, 2)) == whole and len(whole) > 100
    # an empty row of the same id makes each chunk one whose rows share an id: they are joined, and each score comes twice
    twice = chunks.unionByName(chunks.withColumn("content", F.lit(" ")))
    both = rows(fallback.scored(twice, q, 4))
    assert {r for r in both} >= set(whole) and len(both) == 2 * len(whole)


def test_set_join_takes_rows_that_share_an_id_as_one_set(spark):
    texts = [(1, "a b c d e f g h i"), (1, "j"), (2, "a b c d e f g h i j k"), (3, "a b c d e f g h x y z")]
    pairs, _ = set_join.links(spark.createDataFrame(texts, "chunk_id long, content string"))
    assert rows(pairs) == [(1, 2, 10, 10, 11, 1.0)]
