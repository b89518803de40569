"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3. In a context, a seen
byte has the probability count / (total + distinct), an unseen one the escape
probability distinct / (total + distinct) times its probability in the next
shorter context; under order 0 every byte is equally likely. As the statistics
are frozen, a byte's exact code length depends on the byte and the three
before it only. So a text's code length under a language is a sum over its
byte 4-grams, every byte of the whole text; the shortest one wins. The trees
are sorted arrays of all counted grams; nothing that was counted is left out.
A task looks each distinct 4-gram up once and keeps its code lengths.

The trees are counted by Spark over a bounded sample of labelled rows; only
counts of byte 4-grams reach the driver.

Defined results: null texts and texts without a letter are `und` with score 0;
so is every text if nothing could be learnt. Ties go to the smallest language
by name. A very long text is scored whole, a block of bytes at a time. Each
row gives one row, repeated rows and null ids included; an empty table gives
an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import CHUNK_BYTES, lean, per_text, pieces, utf8

#: Bytes before each text.
START = b"\n\n\n"
#: Bytes of code lengths that a task keeps.
KEPT_BYTES = 32 << 20
ORDERS = 4


@dataclass
class Tree:
    """One language's contexts: per order the sorted grams with their bits, and the sorted contexts with the bits of an escape."""

    grams: list[np.ndarray]
    gram_bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape_bits: list[np.ndarray]

    def bits(self, four: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of 4-grams (big-endian numbers) after the three bytes before them."""
        out = np.full(len(four), 8.0)
        for order in range(ORDERS):
            gram = four & np.uint64((1 << 8 * (order + 1)) - 1)
            at, seen = _found(self.contexts[order], gram >> np.uint64(8))
            escaped = np.where(seen, self.escape_bits[order][at], 0) + out
            at, seen = _found(self.grams[order], gram)
            out = np.where(seen, self.gram_bits[order][at], escaped)
        return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def tree_of(grams: np.ndarray, counts: np.ndarray) -> Tree:
    """The tree of counted 4-grams."""
    out = Tree([], [], [], [])
    for order in range(ORDERS):
        keys, of = np.unique(grams.astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        n = np.bincount(of, counts)
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        distinct = np.bincount(of)
        total = np.bincount(of, n) + distinct
        out.grams.append(keys)
        out.gram_bits.append(np.log2(total[of] / n))
        out.contexts.append(contexts)
        out.escape_bits.append(np.log2(total / distinct))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    trees: list[Tree]
    _known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    _bits: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "trees": self.trees, "_known": np.zeros(0, np.uint64), "_bits": None}

    def _looked_up(self, distinct: np.ndarray) -> np.ndarray:
        """Code lengths (gram, language) of distinct 4-grams; those found before are kept."""
        if self._bits is None or self._bits.nbytes > KEPT_BYTES:
            self._known, self._bits = np.zeros(0, np.uint64), np.zeros((0, len(self.trees)))
        new = distinct[~np.isin(distinct, self._known)]
        if len(new):
            known = np.concatenate([self._known, new])
            bits = np.concatenate([self._bits, np.stack([t.bits(new) for t in self.trees], 1)])
            order = np.argsort(known)
            self._known, self._bits = known[order], bits[order]
        return self._bits[np.searchsorted(self._known, distinct)]

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text of a piece under each language."""
        raw, offsets = utf8(texts)
        if len(texts) == 1 and len(raw) > CHUNK_BYTES:
            # a long text block by block, each after the three bytes before it
            whole = np.concatenate([np.frombuffer(START, np.uint8), raw])
            return sum(self._blocks(whole[i : i + CHUNK_BYTES + 3], np.array([0, min(CHUNK_BYTES, len(raw) - i)]), 1) for i in range(0, len(raw), CHUNK_BYTES))
        n, k = len(texts), len(START)
        # the texts, each after START
        s = np.full(len(raw) + n * k, START[0], np.uint8)
        s[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1) * k, np.diff(offsets))] = raw
        return self._blocks(s, offsets, n)

    def _blocks(self, s: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
        s = s.astype(np.uint32)
        four = (s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]
        k = len(START)
        own = np.arange(offsets[-1]) + np.repeat(np.arange(n) * k, np.diff(offsets))
        coded = pa.array(four[own]).dictionary_encode()
        bits = self._looked_up(coded.dictionary.to_numpy().astype(np.uint64))
        code = coded.indices.to_numpy()
        return np.stack([per_text(bits[code, j], offsets) for j in range(bits.shape[1])], 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, t in pieces(texts):
            letter = pc.match_substring_regex(t, r"\p{L}").to_numpy(zero_copy_only=False)
            if not self.languages:
                names += ["und"] * len(t)
                scores.append(np.zeros(len(t)))
                continue
            length = self.code_lengths(t)
            best = length.argmin(1)
            odds = np.exp2(np.clip(length.min(1, keepdims=True) - length, -1000, 0))
            names += [self.languages[b] if has else "und" for b, has in zip(best, letter, strict=True)]
            scores.append(np.where(letter, 1 / odds.sum(1), 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """The model of counted byte 4-grams, as {language: (4-grams as big-endian numbers, counts)}."""
    languages = sorted(counts)
    return LanguageModel(languages, [tree_of(*counts[x]) for x in languages])


def train(documents: DataFrame, rows_per_language: int = 1500) -> LanguageModel:
    """Count the context trees over a bounded sample of the rows whose lang is not null.

    rows_per_language bounds the sample, which a hash of doc_id spreads over
    all labelled rows.
    """
    known = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return model_of({})
    most = 1 << 30
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(most * min(1.0, rows_per_language / n))))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(most)) < share[F.col("lang")])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for lang in pc.unique(b.column(1)):
                own = b.filter(pc.equal(b.column(1), lang)).column(0)
                for _, t in pieces(own):
                    whole = np.frombuffer(b"".join(START + x for x in t.cast(pa.binary()).to_pylist()), np.uint8)
                    for i in range(0, len(whole) - 3, CHUNK_BYTES):
                        raw = whole[i : i + CHUNK_BYTES + 3].astype(np.uint32)
                        g, n = np.unique((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    out = {}
    for lang in counts:
        own = table.filter(pc.equal(table["lang"], lang))
        if own.num_rows:
            out[lang] = (own["gram"].to_numpy(), own["n"].to_numpy())
    return model_of(out)


def identified(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of each whole text; other columns are not read."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            names, scores = held.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
