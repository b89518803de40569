import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from quillstone.llm import packing

ODD = ["", None, " ", "It's DON'T we'll '", "ÀÉÎ Øß÷× ÿŸ İst", "a<|endoftext|>b", "é ́x", "日本語 text", "1234 ½ x2y3", "\x00\x1c a", "ΑΣ ﬁ 😀", "a\x7fb café’s", "``--=@[\\]^_{|}~", "word " * 9000]


def test_ids_and_round_trip(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (10_003, "repeated id")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    pieces = packing.packed(df).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    # every id in one piece, in order, with the right checksum
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        fits = [ids for ids in want[p["doc_id"]] if len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert fits
        spans[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in want.values() for x in v)
    for (doc, n), s in spans.items():
        if len(want[doc]) == 1:
            assert sorted(s)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(s), sorted(s)[1:])) and sum(x[1] for x in s) == n
    partial = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        partial += at < 2048
    assert partial <= 3  # one for each task


def test_pieces_carry_their_ids(spark):
    """The pieces of a document put together are what the tokenizer gives, and a sequence is its pieces by offset."""
    rows = [(1, "word " * 3000), (2, "a short text"), (3, None), (4, "other words " * 900)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in rows:
        own = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == i)
        assert [x for _, ids in own for x in ids] == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    assert all(len(p["ids"]) == p["length"] and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)


def test_sum_of_squares_rule():
    p = packing.Packer(10)
    rng = np.random.default_rng(3)
    for row in range(300):
        size = int(rng.integers(1, 10))
        before = {level: len(w) for level, w in p.open.items() if w}
        full = p.place((row, 0), size)
        after = {level: len(w) for level, w in p.open.items() if w}
        total = sum(n * n for n in after.values())
        options = []
        for level in [0, *before]:
            if level + size <= 10:
                o = dict(before)
                if level:
                    o[level] -= 1
                if level + size < 10:
                    o[level + size] = o.get(level + size, 0) + 1
                options.append(sum(n * n for n in o.values()))
        assert total == min(options)
        assert full is None or sum(x[2] if len(x) > 3 else 0 for x in full) >= 0
        assert all(p.count[level] == len(w) for level, w in p.open.items())


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
