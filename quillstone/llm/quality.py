"""Quality rules by repetition coverage.

Words are hashed, n-grams of several lengths get rolling hashes, and a word
counts as repeated if it lies in an n-gram that the text has at least twice.
A rule compares the share of the words' characters that are repeated (for each
length) and of those in lines equal to an earlier line with its limit. Next to
these limits, one repetition of one short line is allowed. A longer n-gram is
a stronger sign, so its limit is lower: a text may fail on any of them alone.

Defined results: null, empty and word-less texts have zero counts and fail the
base rule of 20 words. A very long text is judged whole; a task holds a hash
and a size for each of its words, not the words. Each row gives one row,
repeated rows and null ids included, and texts are scored alone; an empty
table gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._arrow import hashed_words, lean, mix, pieces, utf8

#: Largest share of characters in duplicated n-grams of so many words, the published limits of a common rule set.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that are equal to an earlier line.
LINE_LIMIT = 0.20
#: A short text that repeats one line once has up to a quarter of its characters there. So one repetition of one line of at
#: most so many words is left out of the shares, as long as they are under these limits with it.
ONE_LINE_WORDS, ONE_LINE_NGRAMS, ONE_LINE_LINES = 20, 0.30, 0.25
#: The base rule: fewest words, window of repeated words, and largest percentage of words in repeated windows.
LEAST_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def covered(offsets: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in an n-gram of words that its text has at least twice."""
    out = np.zeros(len(h) + 1, np.int64)
    if len(h) < n:
        return out[:-1] > 0
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(text[: len(h) - n + 1] == text[n - 1 :])
    rolled = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    key = mix(rolled[starts] ^ mix(text[starts].astype(np.uint64) + np.uint64(1)))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        repeated = starts[np.isin(key, twice)]
        np.add.at(out, repeated, 1)
        np.add.at(out, np.minimum(repeated + n, len(h)), -1)
    return np.cumsum(out[:-1]) > 0


def lines(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """The lines of data[at:end]."""
    while at <= end:
        stop = data.find(b"\n", at, end)
        stop = end if stop < 0 else stop
        yield data[at:stop]
        at = stop + 1


def repetition(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a piece."""
    raw, ends = utf8(texts)
    offsets, h, sizes = hashed_words(texts)
    h = mix(h)
    total = lambda values: np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    of = lambda values, bounds: (x := total(values))[bounds[1:]] - x[bounds[:-1]]
    out = {"n_words": np.diff(offsets), "word_chars": of(sizes, offsets), "n_symbols": of(_SYMBOL[raw], ends)}
    # lines that have a word and are equal to an earlier line of the text
    n_dup, dup_chars, one_line = (np.zeros(len(texts), np.int64) for _ in range(3))
    data = raw.tobytes()
    for i in range(len(texts)):
        if data.find(b"\n", ends[i], ends[i + 1]) < 0:
            continue
        seen: set[bytes] = set()
        for line in lines(data, ends[i], ends[i + 1]):
            key = line if len(line) <= 16 else xxhash.xxh3_128_digest(line) + len(line).to_bytes(8)
            if key in seen:
                if parts := line.split():
                    n_dup[i] += 1
                    size = sum(len(p.decode()) for p in parts)
                    dup_chars[i] += size
                    if len(parts) <= ONE_LINE_WORDS:
                        one_line[i] = max(one_line[i], size)
            else:
                seen.add(key)
    out |= {"n_dup_lines": n_dup, "dup_line_chars": dup_chars, "one_line_chars": one_line}
    for n in sorted({BASE_WINDOW, *NGRAM_LIMITS}):
        repeated = covered(offsets, h, n)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = of(repeated, offsets)
        if n in NGRAM_LIMITS:
            out[f"dup_chars_{n}"] = of(np.where(repeated, sizes, 0), offsets)
    return out


def within(repeated: np.ndarray, one_line: np.ndarray, chars: np.ndarray, limit: float, most: float) -> np.ndarray:
    """Whether the repeated characters are under the limit, or are without one line's and under `most` with it."""
    return (repeated <= limit * chars) | ((repeated - one_line <= limit * chars) & (repeated <= most * chars))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the characters in duplicated lines and n-grams."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_LIMITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for start, texts in pieces(b.column(1)):
                x = repetition(texts)
                failed = (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > BASE_PERCENT * x["n_words"])
                chars = np.maximum(x["word_chars"], 1)
                good = within(x["dup_line_chars"], x["one_line_chars"], chars, LINE_LIMIT, ONE_LINE_LINES)
                for n, limit in NGRAM_LIMITS.items():
                    # both places of the line are in duplicated n-grams
                    good &= within(x[f"dup_chars_{n}"], 2 * x["one_line_chars"], chars, limit, ONE_LINE_NGRAMS)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), *(pa.array(x[c]) for c in counts), pa.array(failed), pa.array(good & ~failed), *(pa.array(x[c]) for c in more)], ["doc_id", *counts, "base_failed", "kept", *more])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean, {', '.join(f'{c} long' for c in more)}")
