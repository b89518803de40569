"""Toxicity by compression distance.

Windows of running text (about WINDOW bytes from a word's start on, a new one
every STEP bytes) are compressed twice, with a zstandard dictionary trained on
ordinary texts, and with the same after one trained on toxic passages, so that
ordinary matches cost the same in both. A window's gain is the difference of
the two lengths.

Toxic documents are mostly ordinary text. So their passages are found by
compression too: dictionaries trained on the whole texts of some toxic
documents compress the others, and windows whose gain is passed by one ordinary
window in fifty only are the passages. The dictionary that judges is
trained on those. What reads like a passage is cut out of the ordinary texts
before their dictionary is trained, because a phrase that it holds gives no gain
to anyone.

What many documents share (a common language's insults, say) would crowd out
what fewer do. So texts are told apart by kind, again by compression: their
beginnings are clustered by the dictionary that compresses them best, and
each kind has an ordinary and a toxic dictionary of its own. Where a kind has too
few labelled rows for that, all texts are one kind, with a second toxic dictionary
for the toxic documents that the first one misses.

A document's score is a logistic function of how many windows reach each gain,
with weights for all kinds and deviations for each.
It is fitted on gains that each labelled document has under dictionaries it
was not in (FOLDS parts), so the thresholds are calibrated for unseen texts.

Defined results: null, empty and word-less texts have no window and get the
score of a document without gains. A very long text is compressed whole, block
by block; long words are windows like others. Every row of the input gives one
row of the output, repeated rows and null ids included; an empty table gives
an empty one. Other columns are not read, whatever their names. Without a
toxic and an ordinary labelled row nothing can be learnt and every score is 0.
Labelled rows with equal texts are learnt from once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, lean, per_text, pieces, utf8

#: Bytes of a window, and of the shortest distance from one to the next. zstd starts no match in a block's last eight
#: bytes, so this leaves words of up to twelve bytes whole in some window.
WINDOW, STEP = 32, 12
#: A greedy search with tables that are large enough to hold every place of the dictionaries; the usual levels' forget most of them.
PARAMETERS = {"strategy": zstandard.STRATEGY_GREEDY, "window_log": 18, "hash_log": 19, "chain_log": 18, "search_log": 5, "min_match": 4, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
#: Bytes of the ordinary dictionary, and of the toxic one while passages are searched.
ORDINARY_BYTES, SEARCH_BYTES = 112 << 10, 8 << 10
#: Bytes of the ordinary dictionary beside which rarer passages are found: it has no room for a phrase that ordinary texts hold now and then.
SMALL_BYTES = 20 << 10
#: Windows of ordinary texts with a larger gain than this beside it are cut out.
CUT_GAIN = 1
#: The toxic dictionary is trained in two parts (bytes, bytes of a segment, bytes that must recur): for phrases and long words, and for short ones.
TOXIC_PARTS = ((1536, 12, 8), (512, 8, 6))
#: Passages have a gain that this share of ordinary windows doesn't exceed.
QUANTILE = 0.98
FOLDS = 4
#: Gains at which windows are counted.
GAINS = (1, 2, 3, 4, 5, 6, 8)
#: Bytes of a text's beginning by which its kind is told, and of a kind's dictionary of them.
HEAD_BYTES, HEADS_BYTES = 768, 4096
#: Clusters that are sought, and rounds of the search; those are joined that compress each other's texts with less than this share more bytes.
CLUSTERS, ROUNDS, UNLIKE = 8, 6, 0.1
#: Clusters with fewer rows of a class join the nearest; with fewer in a kind than the second number, all texts are one kind.
FEW_ROWS, KIND_ROWS = 20, 75
#: How easily a kind's weights differ from those of all.
KIND_SHARE = 0.5
#: Bytes of text of which the windows are held at once.
BLOCK = STEP << 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows of padded texts that lie one after another in raw."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    space = _SPACE[raw]
    begins = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(begins & ~space)
    text = np.searchsorted(offsets, starts, side="right") - 1
    step = (starts - offsets[text]) // STEP
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (step[1:] != step[:-1])])[: len(starts)]
    starts, text = starts[new], text[new]
    return text, starts, np.minimum(starts + WINDOW, offsets[text + 1])


def lengths(compressor: zstandard.ZstdCompressor, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Compressed lengths of windows."""
    if not len(starts):
        return np.zeros(0, np.int64)
    spans = np.stack([starts, ends - starts], 1).astype(np.uint64)
    out = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, spans.tobytes()))
    return np.fromiter(map(len, out), np.int64, len(out))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=held)


def _dictionary(samples: Sequence[bytes], size: int, segment: int, gram: int) -> bytes:
    """A dictionary that zstandard trains on the samples; few samples are given to it several times."""
    samples = [s for s in samples if len(s) >= 8]
    if not samples:
        return b""
    times = max(-(-20 * size // sum(map(len, samples))), -(-64 // len(samples)))
    return zstandard.train_dictionary(size, list(samples) * times, k=segment, d=gram).as_bytes()


@dataclass
class Kind:
    """Texts of one kind: the dictionary of beginnings that it is told by, the ordinary one and the toxic ones."""

    heads: bytes
    ordinary: bytes
    toxic: list[bytes]


@dataclass
class ToxicityModel:
    kinds: list[Kind]
    weights: np.ndarray | None = None

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {"kinds": self.kinds, "weights": self.weights, "_ready": None}

    @property
    def ordinary(self) -> bytes:
        """The ordinary dictionary of the kind that most texts are of."""
        return self.kinds[0].ordinary

    @property
    def toxic(self) -> bytes:
        return self.kinds[0].toxic[0]

    @property
    def second(self) -> bytes:
        return b"".join(self.kinds[0].toxic[1:])

    def gains(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n + 1 offsets of the texts' windows, gain of each window) of lower-cased texts of a piece, by the first kind's first dictionary."""
        return _gains(texts, *self._judges()[0][:2])

    def features(self, texts: pa.Array) -> np.ndarray:
        kind, judges = _nearest([k.heads for k in self.kinds], _heads(texts)), self._judges()
        out = np.zeros((len(texts), 0 if self.weights is None else len(self.weights)))
        for k in np.unique(kind):
            rows = np.flatnonzero(kind == k)
            own = texts.take(pa.array(rows)) if len(rows) < len(texts) else texts
            out[rows] = _of_kind(_features(own, *_gains(own, *judges[k])), k, len(judges))
        return out

    def _judges(self) -> list[list[zstandard.ZstdCompressor]]:
        if self._ready is None:
            self._ready = [[_compressor(x + k.ordinary) for x in (b"", *k.toxic)] for k in self.kinds]
        return self._ready

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        out = [1 / (1 + np.exp(-np.clip(self.features(t) @ self.weights, -30, 30))) for _, t in pieces(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def _of_kind(x: np.ndarray, kind: int, kinds: int) -> np.ndarray:
    """Features of texts of a kind: those, and where there are kinds, a share of them again in the kind's own columns."""
    return np.concatenate([x, *(x * (KIND_SHARE * (k == kind)) for k in range(kinds))], 1) if kinds > 1 else x


def _heads(texts: pa.Array) -> list[bytes]:
    raw, offsets = utf8(texts)
    return [raw[a : min(b, a + HEAD_BYTES)].tobytes().translate(LOWER) for a, b in zip(offsets, offsets[1:])]


def _costs(dictionaries: Sequence[bytes], heads: list[bytes]) -> np.ndarray:
    """Compressed length of each head under each dictionary."""
    size = np.fromiter(map(len, heads), np.int64, len(heads))
    raw, ends, some = np.frombuffer(b"".join(heads), np.uint8), np.cumsum(size), size > 0
    out = np.zeros((len(dictionaries), len(heads)), np.int64)
    for cost, d in zip(out, dictionaries, strict=True):
        cost[some] = lengths(_compressor(d), raw, (ends - size)[some], ends[some])
    return out


def _nearest(dictionaries: Sequence[bytes], heads: list[bytes]) -> np.ndarray:
    """The dictionary that compresses each head best."""
    return _costs(dictionaries, heads).argmin(0) if len(dictionaries) > 1 else np.zeros(len(heads), np.int64)


def _told_apart(heads: list[bytes], toxic: list[bytes]) -> list[bytes]:
    """A dictionary of each kind, largest first: clusters of ordinary heads (k-means by compressed length), of which near ones are joined."""
    whole = [h for h in heads if len(h) == HEAD_BYTES]
    if len(whole) < FEW_ROWS * CLUSTERS:
        return [b""]

    def trained(found: list[bytes]) -> list[bytes]:
        kind = _nearest(found, heads)
        return [d for j in range(len(found)) if (d := _dictionary([h for h, k in zip(heads, kind, strict=True) if k == j], HEADS_BYTES, 32, 8))]

    pick = np.random.default_rng(7)
    found = [whole[pick.integers(len(whole))]]
    best = _costs(found, whole)[0].astype(float)
    while len(found) < CLUSTERS:
        far = np.clip(best - np.quantile(best, 0.02), 0, None) ** 2 + 1e-9
        found.append(whole[pick.choice(len(whole), p=far / far.sum())])
        best = np.minimum(best, _costs(found[-1:], whole)[0])
    for _ in range(ROUNDS):
        found = trained(found)
    while len(found) > 1:
        costs, n = _costs(found, heads), len(found)
        kind = costs.argmin(0)
        rows = np.minimum(*(np.bincount(k, minlength=n) for k in (kind, _nearest(found, toxic))))
        sums = np.stack([costs[:, kind == j].sum(1) for j in range(n)]) + 1.0
        unlike = sums / np.diag(sums)[:, None] - 1
        unlike = (unlike + unlike.T) / 2
        unlike[rows < FEW_ROWS] -= 1
        np.fill_diagonal(unlike, np.inf)
        pair = np.unravel_index(unlike.argmin(), unlike.shape)
        if unlike[pair] >= UNLIKE:
            return [found[j] for j in np.argsort(-np.bincount(kind, minlength=n), kind="stable")] if rows.min() >= KIND_ROWS else [b""]
        both = _dictionary([h for h, k in zip(heads, kind, strict=True) if k in pair], HEADS_BYTES, 32, 8)
        found = [d for k, d in enumerate(found) if k not in pair] + [both]
    return [b""]


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-cased texts, each with a blank before it and eight after it, so that their last words can match; their n + 1 offsets."""
    raw, offsets = utf8(texts)
    size = np.diff(offsets)
    out = np.full(len(raw) + 9 * len(size), 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(9 * np.arange(len(size)) + 1, size)] = raw
    return np.frombuffer(out.tobytes().translate(LOWER), np.uint8), offsets + 9 * np.arange(len(offsets))


def _gains(texts: pa.Array, one: zstandard.ZstdCompressor, *others: zstandard.ZstdCompressor) -> tuple[np.ndarray, ...]:
    """n + 1 offsets of the texts' windows, and the windows' gains under each of the others."""
    raw, offsets = _padded(texts)
    text, starts, ends = windows(raw, offsets)
    gains: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in others]
    for i in range(0, len(starts), BLOCK // STEP):
        spans = starts[i : i + BLOCK // STEP], ends[i : i + BLOCK // STEP]
        plain = lengths(one, raw, *spans)
        for gain, other in zip(gains, others, strict=True):
            gain.append(plain - lengths(other, raw, *spans))
    return np.searchsorted(text, np.arange(len(texts) + 1)), *map(np.concatenate, gains)


def _features(texts: pa.Array, at: np.ndarray, *gains: np.ndarray) -> np.ndarray:
    """Of each text: its size, logarithmic; of each dictionary's gains the windows that reach each (logarithmic, and as a share), the largest and the mean gain."""
    size, n = np.diff(utf8(texts)[1]), np.maximum(np.diff(at), 1)
    out = [np.ones(len(size)), np.log1p(size)]
    for gain in gains:
        for g in GAINS:
            count = per_text((gain >= g).astype(np.int64), at)
            out += [np.log1p(count), 10 * count / n]
        out += [per_text(gain, at, np.maximum), per_text(gain, at) / n]
    return np.stack(out, 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by ridge-penalised logistic regression (Newton's method), with either class as half of the rows."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], ridge: float = 1.0, odds: float | None = None) -> ToxicityModel:
    """Train the dictionaries and calibrate the thresholds on whole labelled texts.

    odds: toxic to ordinary rows where the texts were drawn from; by default those of the texts.
    """
    bad, good = ([t.encode().translate(LOWER) for t in dict.fromkeys(ts)] for ts in (toxic, ordinary))
    if not bad or not good:
        return ToxicityModel([])
    heads = [[t[:HEAD_BYTES] for t in ts] for ts in (bad, good)]
    found = _told_apart(heads[1], heads[0])
    of = [[[t for t, k in zip(ts, _nearest(found, hs), strict=True) if k == j] for j in range(len(found))] for ts, hs in zip((bad, good), heads, strict=True)]
    kinds, rows = [], ([], [])
    for k, d in enumerate(found):
        base, judges, apart = _trained(of[0][k], of[1][k], ridge, odds or len(bad) / len(good), len(found) == 1)
        kinds.append(Kind(d, base, judges))
        for out, xs in zip(rows, apart, strict=True):
            out.extend(_of_kind(x, k, len(found)) for x in xs)
    return ToxicityModel(kinds, _weighed(rows, ridge, odds or len(bad) / len(good)))


def _weighed(rows: tuple[list[np.ndarray], list[np.ndarray]], ridge: float, odds: float) -> np.ndarray:
    """Weights by features of toxic and of ordinary texts."""
    marks = [np.full(len(x), mark) for xs, mark in zip(rows, (1, 0), strict=True) for x in xs]
    w = _logistic(np.concatenate(rows[0] + rows[1]), np.concatenate(marks), ridge)
    w[0] += np.log(odds)  # back to the odds of all rows, so that ordinary texts are left alone
    return w


def _trained(bad: list[bytes], good: list[bytes], ridge: float, odds: float, twice: bool) -> tuple[bytes, list[bytes], tuple[list[np.ndarray], list[np.ndarray]]]:
    """A kind's ordinary dictionary, its toxic ones (with twice, also one for what the first misses), and features of its texts under dictionaries that they were not in."""
    whole, small = (_dictionary(good, size, 64, 8) for size in (ORDINARY_BYTES, SMALL_BYTES))
    column = lambda ts: pa.array([t.decode() for t in ts], pa.string())

    def under(base: bytes, toxic: Sequence[bytes], ts: list[bytes], by):
        judges = [_compressor(x + base) for x in (b"", *toxic)]
        return [by(t, *_gains(t, *judges)) for _, t in pieces(column(ts))] if ts else []

    parts = range(min(FOLDS, max(2, len(bad))))
    of = lambda ts, f: ts[f :: len(parts)]
    others = lambda texts, f: [t for g in parts if g != f for t in texts[g]]

    def searched(base: bytes, texts: list[list[bytes]]) -> list[list[bytes]]:
        """Passages of each part of toxic texts, by a dictionary of the other parts."""
        out: list[list[bytes]] = []
        for f in parts:
            first = _dictionary(others(texts, f) or texts[f], SEARCH_BYTES, 32, 8)
            usual = np.concatenate([np.zeros(1), *under(base, [first], of(good, f), lambda t, at, gain: gain)])
            least = max(1.0, float(np.quantile(usual, QUANTILE)))

            def found(t: pa.Array, at: np.ndarray, gain: np.ndarray, least=least) -> list[bytes]:
                raw, offsets = _padded(t)
                _, starts, ends = windows(raw, offsets)
                data = raw.tobytes()
                return [data[a:b] for a, b in zip(starts[gain > least], ends[gain > least], strict=True)]

            out.append([w for ws in under(base, [first], texts[f], found) for w in ws])
        return out

    def rest(t: pa.Array, at: np.ndarray, gain: np.ndarray) -> list[bytes]:
        """What windows with a gain leave of the texts."""
        raw, offsets = _padded(t)
        _, starts, ends = windows(raw, offsets)
        steps = np.zeros(len(raw) + 1, np.int64)
        np.add.at(steps, starts[gain > CUT_GAIN], 1)
        np.add.at(steps, ends[gain > CUT_GAIN], -1)
        free = np.concatenate([[0], np.cumsum(steps)[:-1] == 0, [0]])
        data, edges = raw.tobytes(), np.flatnonzero(np.diff(free))
        return [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]

    def trained(chosen: list[list[bytes]]) -> bytes:
        return b"".join(_dictionary([w for ws in chosen for w in ws], *part) for part in TOXIC_PARTS)

    def apart(base: bytes, *passages: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Features of each part of the toxic and of the ordinary texts, by dictionaries of the other parts' passages."""
        judges = [[trained([p for g, p in enumerate(ps) if g != f]) for ps in passages] for f in parts]
        none = np.zeros((0, 2 + len(passages) * (2 * len(GAINS) + 2)))
        return tuple([np.concatenate([none, *under(base, judges[f], of(ts, f), _features)]) for f in parts] for ts in (bad, good))

    passages = [searched(whole, [of(bad, f) for f in parts])]
    if twice:
        rows = apart(whole, *passages)
        w = _weighed(rows, ridge, odds)
        missed = [[t for t, s in zip(of(bad, f), rows[0][f] @ w, strict=True) if s < 0] for f in parts]
        passages.append(searched(small, missed))
    toxic = [trained(p) for p in passages]
    base = _dictionary([w for ws in under(small, [b"".join(toxic)], good, rest) for w in ws], ORDINARY_BYTES, 64, 8) or whole
    return base, toxic, apart(base, *passages)


def train(documents: DataFrame, labels: DataFrame, toxic_rows: int = 1000, ordinary_rows: int = 2000) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows, at the odds of all of them.

    documents: doc_id, text; labels: doc_id, toxic (1 or 0; other values and
    null ids are no labels, a document that has both counts as toxic).
    toxic_rows and ordinary_rows bound the sample, which is spread over all
    labelled rows by a hash of doc_id; their texts are learnt from whole.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = 1 << 30
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(most))
    share = {k: int(most * min(1.0, rows / max(1, counts.get(k, 0)))) for k, rows in ((1, toxic_rows), (0, ordinary_rows))}
    sample = known.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    # rows that repeat an id are one labelled row
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    odds = counts[1] / counts[0] if counts.get(1) and counts.get(0) else None
    return fit([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], odds=odds)


def scored(documents: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """doc_id and the score of each whole text; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)), pa.float64())], ["doc_id", name])

    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {name} double")


def without_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold, with all their columns."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            yield b.filter(pa.array(model.score(b.column(at)) < threshold))

    return documents.mapInArrow(run, documents.schema)
