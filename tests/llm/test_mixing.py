import math
import struct

import pytest
import xxhash
from brute import WORD
from pyspark.sql import functions as F

from quillstone.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def h(*values):
    """Spark's xxhash64 of ('q' long or 'i' int, value) or strings; nulls leave the seed."""
    seed = 42
    for v in values:
        if v is None or v == ("q", None):
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<" + v[0], v[1])
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target}: what is over is dealt out again until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def mix(rows, **options):
    """[(doc_id, source, size, copies)] of (doc_id, source, text) rows with different keys."""
    docs = [(i, s, len(WORD.findall(t or "")), h(("q", i), s, ("q", h(t, ("i", 0))), ("q", 0))) for i, s, t in rows]
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    targets, out = shares(sizes, **options), []
    for s in sizes:
        mine = [d for d in docs if d[1] == s]
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        whole, units = math.floor(rate), []
        for i, _, n, u in mine:
            mass = math.floor((rate - whole) * (n << 20) + 0.5)
            if 0 < mass < n << 20:
                units.append((i, n, u, mass))
            else:
                out.append((i, s, n, whole + (n > 0 and mass == n << 20)))
        width, level = max(1, -(-len(mine) // mixing.FAN)), 0
        while True:
            chunks, units = {}, units
            for d in units:
                chunks.setdefault(h(("q", d[2]), ("i", level)) % width, []).append(d)
            left = []
            for chunk in chunks.values():
                held = None
                for x in sorted(chunk, key=lambda d: (-d[1], d[2])):
                    if held is None:
                        held = x
                        continue
                    (i, n, u, a), (j, m, v, b) = held, x
                    up, down = min((n << 20) - a, b), min(a, (m << 20) - b)
                    gain = up if h(("q", u), ("q", v), ("i", level)) % (up + down) < down else -down
                    held = None
                    for d in ((i, n, u, a + gain), (j, m, v, b - gain)):
                        if d[3] in (0, d[1] << 20):
                            out.append((d[0], s, d[1], whole + (d[3] > 0)))
                        else:
                            held = d
                if held:
                    left.append(held)
            units = left
            if width == 1:
                break
            width, level = -(-width // mixing.FAN), level + 1
        out += [(i, s, n, whole + (h(("q", u), ("i", -1)) % (n << 20) < a)) for i, n, u, a in units]
    return out


def by_rows(df):
    return sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fan", [64, 3])
def test_equals_brute_force(spark, sf, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"), "text")
    odd = spark.createDataFrame([(None, "src1", "no id"), (9001, None, "no source at all"), (9002, "src2", None), (9003, "src2", ""), (9004, "empty", " \n"), (9005, "src3", "word " * 50_000)], SCHEMA)
    rows = docs.unionByName(odd)
    got = mixing.plan(rows)
    assert by_rows(got) == sorted(mix([tuple(r) for r in rows.collect()]), key=repr)
    assert by_rows(mixing.plan(rows.repartition(7))) == by_rows(got)


@pytest.mark.parametrize("share", [0.3, 1.0, 1.5])
def test_words_near_the_targets(spark, share):
    # 4,000 documents of one source of skewed sizes, and some small sources
    n = F.pow(F.lit(2.0), F.pmod(F.xxhash64("id"), F.lit(80)) / 10).cast("int") + 1
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.array_join(F.array_repeat(F.lit("w"), n), " ").alias("text"))
    rows = mixing.plan(docs, share=share).collect()
    sizes, taken, target, longest = {}, {}, {}, {}
    for r in rows:
        s = r["source"]
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
        target[s], longest[s] = r["target"], max(longest.get(s, 0), r["size"])
    assert {s: pytest.approx(t) for s, t in shares(sizes, share=share).items()} == target
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)


def test_expectation_and_chance(spark):
    # of 500 equal pairs of documents each gets its copy about as often as its fraction says
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"))
    copies = [r["copies"] for r in mixing.plan(docs, weights=(1,), share=0.3).orderBy("doc_id").collect()]
    assert sum(copies) == 300 and abs(sum(copies[:500]) - 150) < 45


def test_repeated_rows_and_rows_of_the_mix(spark):
    rows = [(None, None, "same words here")] * 200 + [(7, "b", "x y z")] * 3 + [(8, "b", None), (8, "b", None), (9, "b", "long " * 40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("given"), "copies": F.lit("own"), "target": F.lit(None).cast("string")}).repartition(5)
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    null = [r for r in plan if r["source"] is None]
    assert len(null) == 200 and abs(sum(r["taken"] for r in null) - null[0]["target"]) <= 3 and {r["copies"] for r in null} <= {0, 1, 2}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    counts = {(r["doc_id"], r["text"]): r["n"] for r in got.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    want = {}
    for r in plan:
        key = (r["doc_id"], {3: "same words here" if r["source"] is None else "x y z", 0: None, 40: "long " * 40}[r["size"]])
        want[key] = want.get(key, 0) + r["copies"]
    assert counts == {k: n for k, n in want.items() if n}


def test_shuffled_sources_and_no_rows(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = by_rows(mixing.plan(docs))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert by_rows(mixing.plan(docs)) == want
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.plan(blank).collect()] == [(0, 0.0, 0)] * 2
