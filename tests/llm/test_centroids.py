import hashlib
import math

import numpy as np
import pytest

from quillstone.llm import centroids


def plain(rows, k, rounds, dims=64):
    """{(vec_id, n): (cluster, distance)}, final centroids: the contract, vector by vector."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assigned():
        return [min((far(v, c), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        by = assigned()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, by) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assigned())), key=repr), centres


def check(df, rows, k, rounds, dims=64):
    got, centres = centroids.clustered(df, k, rounds, dims)
    want, plain_centres = plain(rows, k, rounds, dims)
    out = got.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out), key=repr) == want
    assert centres == plain_centres
    total = sum(d for _, _, d in want)
    for r in out:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain_centres[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (3, 0), (150, 2)])
def test_equals_brute_force(spark, sf, k, rounds):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").limit(200)
    check(df, [(r["vec_id"], r["embedding"]) for r in df.collect()], k, rounds)


def test_odd_vectors(spark):
    rows = [(1, [0.1, -0.2]), (2, [0.1, -0.2]), (2, [0.1, -0.2]), (2, [5.0, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [None, 0.0]), (6, [0.1]), (7, None), (8, []), (None, [-3.0, 0.015625]), (9, [1e5, -1e5]), (10, [0.0, 0.0]), (11, [-0.001, 0.001])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    for k in (1, 3, 20):
        check(df, rows, k, 2, dims=2)
    assert centroids.clustered(df.limit(0))[0].count() == 0 and centroids.clustered(df.where("vec_id = 5"), dims=2)[0].count() == 0


def test_bounded_components_and_ties(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in centroids.clustered(df, 1, 0, dims=1)[0].collect()}
    first = min(got, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    at = {1: 1 << 27, 2: -(1 << 27), 3: 0}
    assert {i: r["distance"] for i, r in got.items()} == {i: (at[i] - at[first]) ** 2 for i in at}
    # equally far from two centroids: the smaller number
    cluster, distance = centroids.nearest(np.array([[0], [4]]), np.array([[2], [-2], [2], [6]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [4, 4]


def test_slices_and_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    for spread in (3, 10**6):
        vectors, centres = rng.integers(-spread, spread, (500, 8)), rng.integers(-spread, spread, (21, 8))
        full = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
        monkeypatch.setattr(centroids, "BLOCK", 4)
        cluster, distance = centroids.nearest(vectors, centres)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
