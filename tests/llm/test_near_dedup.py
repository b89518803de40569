import random

import numpy as np
import pyarrow as pa
from brute import classes, shingles

from quillstone.llm import near_dedup

SCHEMA = "doc_id long, text string, kept int, component_id string"


def found(spark, rows, shingle=2, **extra):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)
    return {r["doc_id"]: r for r in near_dedup.near_duplicates(df, shingle).collect()}


def test_sets_and_sketches():
    texts = ["", "one", "A b", "a B a b c", "\x1ca\x85b \t\n c"]
    offsets, s = near_dedup.shingle_sets(pa.array(texts), 2)
    assert np.diff(offsets).tolist() == [len(shingles(t, 2)) for t in texts]
    full = np.flatnonzero(np.diff(offsets))
    sig = near_dedup._signatures(np.append(offsets[full], offsets[-1]), s)
    sketch = near_dedup.odd_sketch(sig)
    assert np.bitwise_count(sketch.view(np.uint64)[0] ^ sketch.view(np.uint64)[0]).sum() == 0
    assert 0 < near_dedup.most_differing(0.8) < near_dedup.SKETCH_BITS // 2


def test_equals_brute_force_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for k in (2, 5):
        want = classes(rows, k)
        got = found(spark, rows, k)
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["kept"] == (want[i] == i) and r["n_shingles"] == len(shingles(t, k)) for (i, t) in rows for r in [got[i]])


def test_chains_and_large_families(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(260):  # a family in which many pairs are under the threshold
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
        rows.append((1000 - i, " ".join(words)))
    drift = [f"d{j}" for j in range(100)]
    for i in range(40):  # each is near the next one only
        drift[(i * 5) % 100] = f"e{i}"
        drift[(i * 5 + 2) % 100] = f"f{i}"
        rows.append((2000 + i, " ".join(drift)))
    got = found(spark, rows)
    assert {i: r["component_id"] for i, r in got.items()} == classes(rows, 2)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "one  two"), (7, "one  two"), (8, "x " * 50000), (9, "x y " * 20)]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], SCHEMA)
    got = [tuple(r) for r in near_dedup.near_duplicates(df, 2).collect()]
    assert len(got) == len(rows)
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (None, 1, None, True)} <= set(got)
    assert got.count((7, 1, 6, False)) == 2
    assert near_dedup.near_duplicates(df.limit(0), 2).count() == 0
    kept = near_dedup.one_of_each(df, 2)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 6, 8, 9]


def test_templated_documents_in_mixed_buckets(spark):
    """Documents that share half of their text don't link, but fill buckets; pairs among them that do link are found."""
    rng = random.Random(9)
    frame = [f"t{i}" for i in range(75)]
    rows = [(i, " ".join(frame + [f"n{rng.randrange(10**6)}" for _ in range(25)])) for i in range(700)]
    rows += [(1000 + i, t.rsplit(" ", 4)[0] + f" e{i} f{i} g{i} h{i}") for i, t in rows[::70]]
    got = found(spark, rows)
    want = classes(rows, 2)
    assert {i: r["component_id"] for i, r in got.items()} == want and sum(want[i] != i for i, _ in rows) >= 10


def test_sketches_estimate_high_similarities():
    """The bound passes pairs at the similarity and rejects most pairs well under it."""
    rng = np.random.default_rng(4)
    for share, passes in ((0.8, True), (0.5, False)):
        differing = []
        for _ in range(60):
            common, own = rng.integers(0, 1 << 63, int(2000 * share)), [rng.integers(0, 1 << 63, int(1000 * (1 - share))) for _ in range(2)]
            sets = [np.unique(np.concatenate([common, o]).astype(np.uint64)) for o in own]
            sig = near_dedup._signatures(np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), np.concatenate(sets))
            x = near_dedup.odd_sketch(sig).view(np.uint64)
            j = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            differing.append(np.bitwise_count(x[0] ^ x[1]).sum() <= near_dedup.most_differing(j if passes else 0.85))
        assert np.mean(differing) > 0.99 if passes else np.mean(differing) < 0.05


def test_long_texts_in_runs(monkeypatch):
    text = pa.array([" ".join(f"w{i % 400}" for i in range(5000))])
    whole = near_dedup.shingle_sets(text, 5)[1]
    monkeypatch.setattr(near_dedup, "WORDS_AT_ONCE", 300)
    assert np.array_equal(near_dedup.shingle_sets(text, 5)[1], whole)


def test_texts_are_not_shuffled_to_meet_ids(spark, sf, monkeypatch):
    """Rows go where they are, past broadcast ids; above the limit the joins shuffle, with the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dedup.one_of_each(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        rows = sorted(r["doc_id"] for r in kept.collect())
        monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
        shuffled = sorted(r["doc_id"] for r in near_dedup.one_of_each(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert rows == shuffled and 0 < len(rows) < docs.count()
