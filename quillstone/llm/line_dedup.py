"""Line deduplication by a range partitioning of line hashes.

Lines become (128-bit hash of the key, document, position) and are range
partitioned and sorted by all of it, so the lines of a frequent key lie in
several tasks. Each task streams through its rows and keeps only the first
document of the key it is at. Where a key began in an earlier task, its rows
are marked; one row for each task (its first and last key and the first
document of the last) tells them the document that comes first. What is left
are the dropped positions, which become one compressed keep bitmap for each
document that loses a line; texts don't take part in any of this. Rows then
meet their bitmaps by a join, which shuffles the texts once.

A key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z in lower
case. Keys of at least `least` code points found in at least two documents
keep only their lines in the document with the smallest doc_id.

Defined results: null and empty texts are one empty line and lose nothing.
Rows that repeat a doc_id are one document. Null ids are one document that
comes after all others. Very long texts are split whole, by Spark. Each row of
the input gives one row of the output, and an empty table gives an empty one.
doc_id must be an integer column (else a TypeError); other columns are carried,
whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, integer_ids, lean, pieces

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id.
LAST = (1 << 63) - 1


def _place(documents: DataFrame) -> list[Column]:
    """The document's place, and a hash of the text, by which rows find their bitmaps."""
    integer_ids(documents)
    return [F.coalesce(documents["doc_id"].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(documents["text"]).alias("tag")]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWERED)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, doc, tag, pos), sorted: dropped lines, lines of a key that may have begun before, and at last a border row."""
    names = ["kind", "part", "h1", "h2", "doc", "tag", "pos", "l1", "l2", "leads"]
    part = TaskContext.get().partitionId()
    first_key = key = first_doc = None
    for b in lean(batches):
        if not b.num_rows:
            continue
        h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
        if first_key is None:
            first_key = (int(h1[0]), int(h2[0]))
        new = np.concatenate([[(int(h1[0]), int(h2[0])) != key], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        run = np.cumsum(new) - 1
        firsts = doc[new] if new.any() else doc[:0]
        least = firsts[np.maximum(run, 0)] if len(firsts) else np.full(len(doc), first_doc)
        if not new[0]:
            least = np.where(run < 0, first_doc, least)
        lead = (h1 == first_key[0]) & (h2 == first_key[1])
        out = lead | (doc != least)
        key, first_doc = (int(h1[-1]), int(h2[-1])), int(least[-1])
        if out.any():
            kept = b.filter(pa.array(out))
            n = kept.num_rows
            fill = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(lead[out], 1, 0)), pa.array(np.full(n, part)), *kept.columns, fill, fill, fill], names)
    if key is not None:
        row = [2, part, *first_key, first_doc, 0, 0, *key, int(first_key == key)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names)


def _begun(borders: list) -> dict[int, int]:
    """For each task whose first key began in an earlier one, that key's first document."""
    borders = sorted(borders, key=lambda r: r["part"])
    out: dict[int, int] = {}
    for before, row in itertools.pairwise(borders):
        if (before["l1"], before["l2"]) == (row["h1"], row["h2"]):
            # a task that holds nothing but this key leads on to the document that it has from before
            out[row["part"]] = out.get(before["part"], before["doc"]) if before["leads"] else before["doc"]
    return out


def keep_bitmaps(documents: DataFrame, least: int = 10) -> DataFrame:
    """doc, tag, n_dropped and keep (zlib-compressed bits, 1: keep; lines after the last bit are kept) of documents that lose lines."""
    lines = documents.select(*_place(documents), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "tag", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "tag", F.col("pos").cast("long").alias("pos"))
    order = ["h1", "h2", "doc", "tag", "pos"]
    ranged = cut(hashed).repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(ranged.mapInArrow(_streamed, "kind long, part long, h1 long, h2 long, doc long, tag long, pos long, l1 long, l2 long, leads long"))
    spark = documents.sparkSession
    # one row for each task of the sort, whatever the number of documents
    begun = _begun(found.where("kind = 2").collect())
    earlier = F.broadcast(spark.createDataFrame([*begun.items()], "part long, earlier long"))
    dropped = found.where("kind = 0").select("doc", "tag", "pos")
    own = found.where("kind = 1").groupBy("part").agg(F.min("doc").alias("own"))
    leads = found.where("kind = 1").join(F.broadcast(own), "part").join(earlier, "part", "left").where("doc <> coalesce(earlier, own)").select("doc", "tag", "pos")
    positions = dropped.unionByName(leads).groupBy("doc", "tag").agg(F.collect_set("pos").alias("gone"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            out = []
            for gone in b.column(2):
                gone = gone.values.to_numpy()
                bits = np.ones(int(gone.max()) + 1, np.uint8)
                bits[gone] = 0
                out.append(zlib.compress(np.packbits(bits).tobytes() + bytes([-len(bits) % 8])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.compute.list_value_length(b.column(2)).cast(pa.int64()), pa.array(out, pa.binary())], ["doc", "tag", "n_dropped", "keep"])

    return positions.mapInArrow(bitmaps, "doc long, tag long, n_dropped long, keep binary")


def kept_text(text: str, keep: bytes) -> str:
    """The text without the lines that a keep bitmap drops."""
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    bits = bits[: len(bits) - raw[-1]].tolist()
    return "\n".join(x for x, k in itertools.zip_longest(text.split("\n"), bits, fillvalue=1) if k)


def _joined(documents: DataFrame, least: int, *carried: str) -> DataFrame:
    """row (the columns of documents to carry), n_dropped and keep (null for documents that lose nothing)."""
    bitmaps = keep_bitmaps(documents, least)
    rows = documents.select(*_place(documents), F.struct(*[documents[c] for c in carried]).alias("row"))
    return rows.join(bitmaps, ["doc", "tag"], "left").select("row", "n_dropped", "keep")


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[bytes | None]]]:
    """(rows, texts, bitmaps) of about a MB of text each, of batches of _joined."""
    for b in lean(batches):
        rows = pa.RecordBatch.from_struct_array(b.column(0))
        for at, some in pieces(rows.column(text)):
            n = len(some)
            yield pa.RecordBatch.from_arrays([*rows.slice(at, n).columns, b.column(1).slice(at, n)], [str(i) for i in range(rows.num_columns + 1)]), rows.column(text).slice(at, n).to_pylist(), b.column(2).slice(at, n).to_pylist()


def without_repeated_lines(documents: DataFrame, least: int = 10) -> DataFrame:
    """documents with the lines dropped; all columns, with n_chars (if there) that of the new text."""
    names = documents.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, keeps in _parts(batches, at):
            columns = rows.columns[: len(names)]
            columns[at] = pa.array([kept_text(t, k) if k is not None else t for t, k in zip(texts, keeps, strict=True)], columns[at].type)
            if chars is not None:
                lost = pa.array([k is not None for k in keeps], pa.bool_())
                columns[chars] = pa.compute.if_else(lost, pa.compute.utf8_length(columns[at]).cast(columns[chars].type), columns[chars])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _joined(documents, least, *names).mapInArrow(run, documents.schema)


def digests(documents: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, keeps in _parts(batches, 1):
            n = [(t or "").count("\n") + 1 for t in texts]
            digest = [hashlib.sha256((kept_text(t, k) if k is not None else t or "").encode()).hexdigest() for t, k in zip(texts, keeps, strict=True)]
            dropped = pa.compute.fill_null(rows.column(2), 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), dropped, pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _joined(documents, least, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
