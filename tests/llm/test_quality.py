from brute import repetition as brute

from quillstone.llm import quality


def test_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a b\na b\n\n\na b"), (-4, "one two three four five six seven eight " * 9), (-5, "ü# *%" * 30), (-6, "w " * 30000), (-6, "w " * 30000)]
    got = quality.judged(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, chars, symbols, dup, rep, failed, covered = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, rep, failed)
        assert all(r[f"dup_chars_{k}"] == covered[k] for k in quality.NGRAM_LIMITS)
        assert not (r["kept"] and failed)


def test_verdicts(spark):
    plain = " ".join(f"word{i}" for i in range(200))
    rows = [(1, plain), (2, plain + "\n" + "\n".join(["the same line comes again here"] * 40)), (3, " ".join([f"x{i} some five words here again" for i in range(40)]))]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_limits_of_long_and_short_texts(spark):
    """A quarter of boilerplate is too much in a long page; a short text may repeat one short line once."""
    boilerplate = "\n".join(" ".join(f"b{i}x{j}" for j in range(10)) for i in range(250))
    plain = " ".join(f"word{i}" for i in range(15_000))
    line = "one line of ten words comes at start and end"
    short = f"{line}\n" + " ".join(f"w{i}" for i in range(100)) + f"\n{line}"
    paragraph = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"{boilerplate}\n{plain}\n{boilerplate}"), (2, plain), (3, short), (4, f"{paragraph}\n" + " ".join(f"w{i}" for i in range(180)) + f"\n{paragraph}")]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {1: False, 2: True, 3: True, 4: False}
    assert not any(r["base_failed"] for r in got.values()) and got[3]["dup_chars_10"] > quality.NGRAM_LIMITS[10] * got[3]["word_chars"]


def test_each_length_decides_alone(spark):
    """For each n-gram length a text in which only the limit of that length is passed; limits fall with length."""
    limits = quality.NGRAM_LIMITS
    assert sorted(limits) == list(range(5, 11)) and all(limits[n] > limits[n + 1] for n in range(5, 10))
    rows = []
    for n, limit in limits.items():
        # runs of exactly n words, each found twice: all shorter n-grams are repeated as well, longer ones aren't
        runs = int((limit + 0.005) * 10_000 / (2 * n))
        words, fresh = [], iter(range(10**6))
        for twice in (0, 1):
            for r in range(runs):
                words += [f"r{r:04d}{j:02d}{n:02d}" for j in range(n)]
                words += [f"f{next(fresh):08d}"]
        words += [f"f{next(fresh):08d}" for _ in range(10_000 - len(words))]
        rows.append((n, " ".join(words)))
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, r in got.items():
        over = [k for k, limit in limits.items() if r[f"dup_chars_{k}"] > limit * r["word_chars"]]
        assert over == [n] and not r["kept"] and not r["base_failed"], (n, over)


def test_long_texts_in_segments(monkeypatch):
    """Segments of a long text give the same counts as the whole text."""
    import numpy as np
    import pyarrow as pa

    from quillstone.llm import _arrow

    text = pa.array([("some words of a line that comes again\n" + " ".join(f"w{i}é" for i in range(300)) + "\n") * 7])
    whole = quality.repetition(text)
    cut = lambda x, limit=0: _segments(x, 500)
    _segments = _arrow.segments
    monkeypatch.setattr(_arrow, "segments", cut)
    parts = quality.repetition(text)
    assert all(np.array_equal(whole[k], parts[k]) for k in whole) and len(list(cut(text))) > 10
