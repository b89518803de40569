"""Shared helpers for operators that work on Arrow batches.

Spark partitions and shuffles the rows; the functions here only turn one
batch of texts into numpy arrays, a few MB of text at a time, so that the
memory of a task does not depend on the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

#: Bytes of text that are turned into numpy arrays at once. A single longer text is one piece, of which segments() are taken.
CHUNK_BYTES = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: A-Z to a-z on UTF-8 bytes; other bytes, so all other letters, stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder, or a folder of our own where none is set and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The result has no lineage, so a lost executor never repeats what stands
    before it, and columns that are not needed later are not read again.
    """
    path = os.path.join(checkpoint_root(df.sparkSession), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def integer_ids(documents: DataFrame) -> None:
    """A TypeError if doc_id can't be ordered as an integer."""
    kind = documents.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches. After each one memory that is free goes back to the system, because Spark keeps a worker for later stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        yield b
        del b
        _give_back()


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for runs of rows with about `limit` bytes; nulls become ''."""
    column = pc.fill_null(column.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    start, n = 0, len(column)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop


def segments(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """A piece as it is, or a single longer text in parts of about `limit` bytes that begin and end at white space (a longer word is whole)."""
    raw, offsets = utf8(text)
    if len(text) != 1 or len(raw) <= limit:
        yield text
        return
    data, at = raw.tobytes(), 0
    while at < len(data):
        space = _BLANK.search(data, at + limit)
        stop = space.start() if space else len(data)
        part = data[at:stop]
        yield pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(part)], np.int32)), pa.py_buffer(part))
        at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a piece, and the n + 1 offsets of the texts in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lowered(column: pa.Array) -> pa.Array:
    """A-Z to a-z, nothing else."""
    raw, offsets = utf8(column)
    data = raw.tobytes().translate(LOWER)
    return pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of a piece: (n + 1 offsets of the texts' words, code of each word, distinct words)."""
    lists = pc.ascii_split_whitespace(column)
    flat = lists.values if lists.offset == 0 else lists.flatten()
    bounds = np.asarray(lists.offsets, np.int64)
    bounds = bounds - bounds[0]
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(some)])
    coded = flat.filter(pa.array(some)).dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
    return before[bounds], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in all tasks."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n + 1 offsets of the texts' words, hash of each word, code points of each word) of a piece, a segment at a time."""
    found = []
    for part in segments(column):
        offsets, codes, distinct = words(part)
        if len(codes):
            found.append((hashes(distinct)[codes], pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int32)[codes]))
    h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)])
    sizes = np.concatenate([np.zeros(0, np.int32), *(x for _, x in found)])
    return (offsets if len(column) != 1 else np.array([0, len(h)])), h, sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_text(values: np.ndarray, offsets: np.ndarray, how=np.add) -> np.ndarray:
    """Sums (or another reduction) of the values of each text; 0 for texts without any."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = how.reduceat(values, offsets[full], axis=0)
    return out
