"""Near-duplicate classes by MinHash bands and odd sketches.

1. Each text becomes a MinHash signature over its set of word shingles, the
   bands' hashes, an odd sketch (a bitmap that holds the parity of the
   signature's samples) and a 128-bit digest of the set. Sets that are equal
   are one from here on, so exact copies cost nothing more.
2. Each band bucket pairs its members with its smallest member only. Sketches
   choose the nearest of a document's partners, if they allow the similarity
   (the XOR's population count estimates it), then the full shingle sets are
   compared exactly. Connected components of the links follow.
3. In buckets that still hold several components, members outside the largest
   one are compared with other members of it, in the same way.
4. In buckets that are mixed even then, members outside the largest component
   are a query set against their own bucket, in blocks of BLOCK by BLOCK. A
   first pass deals out sketches only, and gives out the members that have a
   partner by sketch in their block. Only those members' sets are dealt out in
   the second pass, which compares them exactly, the likeliest pairs first,
   and gives out a spanning forest of the links that it finds. So no step makes
   all pairs of a group, full sets go only where a sketch asks for them, and no
   link between components is lost. Comparing sketches takes time in
   proportion to the square of a bucket whose members don't link (some 10^8
   pairs a second), and shuffles 100 bytes for each member and block.

The default is 52 bands of 7 rows: a pair with a similarity of 0.8 shares no
bucket with a probability of 5e-6; its sketch estimate has a standard error of
0.031, and rejects such a pair with a probability of 1e-6.

Defined results: null, empty and word-less texts have an empty set, n_shingles
0, and are a class of their own by doc_id. A text of fewer words than a
shingle is one shingle of all its words. Rows with a null doc_id are kept
as they are and linked with nothing (component_id null, kept true); rows that
repeat a doc_id are one document where their sets are equal, else they are
linked through that id. Of documents that are equally near the smallest
doc_id is taken. A very long text is taken whole: its words' hashes and its set
are held, 8 bytes each. Each row of the input gives one row of the output, and
an empty table gives an empty one. doc_id must be an integer column (else a
TypeError); other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut, hashed_words, integer_ids, lean, lowered, mix, pieces

BANDS, ROWS, SKETCH_BITS = 52, 7, 512
#: A pair goes on to the exact comparison if its sketches estimate at least the similarity less this.
SLACK = 0.15
#: Documents of either side that meet in one block of a bucket.
BLOCK = 256
#: Words of which the shingles are made at once.
WORDS_AT_ONCE = 1 << 20
#: Links (16 bytes each) of a task of the connected components.
LINKS_PER_TASK = 250_000
#: Members of a bucket's largest component that stand for it, by the bucket.
HUBS = 8
#: Rows of ids or pairs of them up to which they are broadcast (some 50 bytes each) to texts and sets, so that those are not shuffled to meet them.
BROADCAST_IDS = 2_000_000

_SEED = np.random.default_rng(20240607)
_A = (_SEED.integers(0, 1 << 32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _SEED.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n + 1 offsets, sorted distinct 64-bit shingle hashes) of the texts of a piece."""
    offsets, h, _ = hashed_words(lowered(texts))
    if len(texts) == 1 and len(h) > WORDS_AT_ONCE:
        # a very long text: runs of words that overlap by k - 1
        runs = [_shingles(np.array([0, len(x)]), x, k) for i in range(0, len(h) - k + 1, WORDS_AT_ONCE) for x in [h[i : i + WORDS_AT_ONCE + k - 1]]]
        members = np.unique(np.concatenate([np.unique(x) for _, x in runs]))
        return np.array([0, len(members)]), members
    ends, s = _shingles(offsets, h, k)
    sets = [np.unique(s[ends[i] : ends[i + 1]]) for i in range(len(ends) - 1)]
    return np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64), np.concatenate([np.zeros(0, np.uint64), *sets])


def _shingles(offsets: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n + 1 offsets, hash of the shingle at each word) from the words' hashes: of k words, or of all words of a shorter text."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    text_of = np.repeat(np.arange(len(n)), count)
    at = np.arange(ends[-1]) - ends[text_of] + offsets[text_of]
    size = np.minimum(n, k)[text_of]
    s = mix(size.astype(np.uint64))
    for j in range(k):
        inside = j < size
        word = h[np.minimum(at + j, len(h) - 1)] if len(h) else h
        s = np.where(inside, mix(s * np.uint64(0x9E3779B97F4A7C15) + word), s)
    return ends, s


def _signatures(offsets: np.ndarray, s: np.ndarray) -> np.ndarray:
    """MinHash signatures (texts x samples, uint32); every text must have a shingle."""
    folded = (s >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1]
    out = np.empty((len(starts), len(_A)), np.uint32)
    for i in range(len(_A)):
        out[:, i] = np.minimum.reduceat(folded * _A[i] + _B[i], starts)
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    x = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), x.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return out.view(np.int64)


def odd_sketch(signature: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, packed (texts x SKETCH_BITS / 64 words)."""
    n, k = signature.shape
    place = mix(signature.astype(np.uint64) * np.uint64(k) + np.arange(k, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    cell = place.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = np.bincount(cell.ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def most_differing(similarity: float) -> int:
    """The population count of an XOR at which the estimate falls to similarity - SLACK."""
    toggles = 2 * BANDS * ROWS * (1 - max(0.0, similarity - SLACK))
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * toggles / SKETCH_BITS)))


def _described(documents: DataFrame, k: int) -> DataFrame:
    """A row for each row of documents: doc_id, n_shingles, digest, bands, sketch (the last three null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for start, texts in pieces(b.column(1)):
                offsets, s = shingle_sets(texts, k)
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                row = np.full(len(size), -1)
                row[full] = np.arange(len(full))
                if len(full):
                    starts = np.append(offsets[full], offsets[-1])
                    sig = _signatures(starts, s)
                    # sums of two scramblings of the members: a digest of the set
                    one, two = (np.add.reduceat(mix(s ^ np.uint64(c)), starts[:-1]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
                    digest = np.stack([one, two], 1).view(np.uint8).reshape(len(full), 16)
                    bands, sketch = _bands(sig), odd_sketch(sig)
                else:
                    digest, bands, sketch = np.zeros((1, 16), np.uint8), np.zeros((1, BANDS), np.int64), np.zeros((1, SKETCH_BITS // 64), np.int64)
                take = pa.array(np.where(row < 0, 0, row), mask=row < 0)
                fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()).take(take)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()).take(take)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(size), fixed(digest), lists(bands), lists(sketch)], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _sets(documents: DataFrame, k: int) -> DataFrame:
    """doc_id and its set (array<long>, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for start, texts in pieces(b.column(1)):
                offsets, s = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(offsets.astype(np.int32), s.view(np.int64))], ["doc_id", "members"])

    return documents.mapInArrow(run, "doc_id long, members array<long>")


def _bits(rows: pa.Table) -> np.ndarray:
    return rows.column("sketch").chunk(0).flatten().to_numpy().view(np.uint64).reshape(rows.num_rows, -1)


def _asked(percent: int):
    """bucket, left, right, side, doc_id of the members of a block that have a partner in another component by sketch."""
    limit = most_differing(percent / 100)

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        root, side = (rows.column(c).to_numpy() for c in ("component", "side"))
        bits = _bits(rows)
        near = np.zeros(len(root), bool)
        right = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            js = right[root[right] != root[i]]
            js = js[np.bitwise_count(bits[js] ^ bits[i]).sum(1) <= limit]
            near[js] = True
            near[i] = len(js) > 0
        names = ["bucket", "left", "right", "side", "doc_id"]
        return pa.RecordBatch.from_arrays([rows.column(c).chunk(0).filter(pa.array(near)) for c in names], names) if near.any() else None

    return _by_block(block)


def _linked(percent: int):
    """Exact links (a, b) between components of a block: a spanning forest of them."""
    limit = most_differing(percent / 100)

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        ids, root, side = (rows.column(c).to_numpy().copy() for c in ("doc_id", "component", "side"))
        bits = _bits(rows)
        members = rows.column("members").chunk(0)
        ends = np.asarray(members.offsets)
        flat = members.values.to_numpy()
        sizes = np.diff(ends)
        right = np.flatnonzero(side == 1)
        found = []
        for i in np.flatnonzero(side == 0):
            js = right[root[right] != root[i]]
            small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
            js = js[100 * small >= percent * large]
            differing = np.bitwise_count(bits[js] ^ bits[i]).sum(1)
            # the likeliest first: a link makes the rest of its component superfluous
            for j in js[np.argsort(differing, kind="stable")][: int((differing <= limit).sum())]:
                if root[j] == root[i]:
                    continue
                common = len(np.intersect1d(flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]], assume_unique=True))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    root[root == root[j]] = root[i]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"]) if found else None

    return _by_block(block)


def _by_block(of_block):
    """Runs of_block on the rows of each (bucket, left, right), which arrive sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in lean(batches):
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "left", "right")], 1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(keys[x]) != key:
                    if (found := of_block(pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield found
                    held = []
                key = tuple(keys[x])
                held.append(batch.slice(x, y - x))
        if held and (found := of_block(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield found

    return run


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast, if the rows are few enough (a table that is read again for the count)."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Alternating large-star and small-star steps: each step is aggregates and
    joins on distributed links, and ends when a step changes nothing.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        # links are small rows: as many tasks as their number asks for
        tasks = max(8, now[0] // LINKS_PER_TASK)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(documents: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text)."""
    integer_ids(documents)
    described = cut(_described(documents, shingle))
    full = described.where("n_shingles > 0 and doc_id is not null")
    # one row for each set that differs, with what the search needs
    unique = cut(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    reps = unique.select("digest", "rep")
    # dealt out once, for the hubs and for the members that meet them
    bands = unique.select("rep", F.explode("bands").alias("bucket")).repartition("bucket")
    hubs = bands.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).where("hub < other").select("bucket", "hub")
    shared = cut(bands.join(hubs, "bucket"))

    # the sketches and the full sets of documents that share a bucket, of sets one for each row
    wanted = _few(cut(shared.select("rep").distinct()))
    sketches = cut(unique.select("rep", "sketch").join(wanted, "rep", "left_semi"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = cut(_sets(texts, shingle).where(F.size("members") > 0))

    def popcount(x: str, y: str):
        bits = [F.bit_count(F.element_at(x, i).bitwiseXOR(F.element_at(y, i))) for i in range(1, SKETCH_BITS // 64 + 1)]
        return sum(bits[1:], bits[0])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links (a, b) of pairs (rep, hub, part): of a rep's hubs in a part, the one with the nearest sketch, if the full sets are similar."""
        near = pairs.distinct().join(sketches.select("rep", F.col("sketch").alias("x")), "rep").join(sketches.select(F.col("rep").alias("hub"), F.col("sketch").alias("y")), "hub")
        near = near.select("rep", "part", F.struct(popcount("x", "y").alias("d"), "hub").alias("h")).where(F.col("h.d") <= most_differing(percent / 100))
        near = cut(near.groupBy("rep", "part").agg(F.min("h").alias("h")).select(F.col("rep").alias("b"), F.col("h.hub").alias("a")))
        # sets that no pair asks for stay where they are
        hub_sets = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")).join(_few(near.select("a").distinct()), "a", "left_semi")
        both = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")).join(_few(near), "b").join(hub_sets, "a")
        common = F.size(F.array_intersect("x", "y"))
        return cut(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"))

    # each bucket's members and its smallest member
    links = confirmed(shared.where("rep <> hub").select("rep", "hub", F.lit(0).alias("part")))
    # rows that repeat an id with another set are linked through the id
    again = full.groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("doc_id")
    again = full.join(again, "doc_id").select("digest", F.col("doc_id").alias("b")).distinct().join(reps.select("digest", F.col("rep").alias("a")), "digest").select("a", "b")
    links = cut(links.unionByName(again))
    comp = cut(components(links))

    def mixed() -> DataFrame:
        """bucket, rep, component, size, hub, hub_component of buckets with several components; the hub is of the largest one, and differs with the bucket."""
        sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
        known = comp.join(sizes, "component").select(F.col("node").alias("rep"), "component", "size")
        rows = shared.select("bucket", "rep").join(known, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
        order = F.struct("size", "component", F.xxhash64("rep", F.pmod("bucket", F.lit(HUBS))))
        chosen = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by(F.struct(F.col("rep").alias("hub"), F.col("component").alias("hub_component")), order).alias("h"))
        return cut(rows.join(chosen.where("low < high").select("bucket", "h.*"), "bucket"))

    # members that are in another component than most of their bucket, and other members of that
    apart = mixed().where("component <> hub_component").select("rep", "hub", F.col("hub_component").alias("part"))
    more = confirmed(apart)
    if not more.isEmpty():
        links = cut(links.unionByName(more))
        comp = cut(components(links))

    # what is left: buckets whose members are in several components
    left = mixed()
    if not left.isEmpty():
        by_bucket = left.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("hub_component")).alias("n_apart"))
        rows = cut(left.join(by_bucket, "bucket").join(sketches, "rep").select("bucket", F.col("rep").alias("doc_id"), "component", "sketch", "n", "n_apart", (F.col("component") != F.col("hub_component")).alias("apart")))
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        own = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        columns = ["doc_id", "component", "sketch"]
        asks = rows.where("apart").select("bucket", own("n_apart").alias("left"), every("n").alias("right"), F.lit(0).alias("side"), *columns)
        answers = rows.select("bucket", every("n_apart").alias("left"), own("n").alias("right"), F.lit(1).alias("side"), *columns)
        dealt = lambda df: df.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
        asked = cut(dealt(asks.unionByName(answers)).mapInArrow(_asked(percent), "bucket long, left int, right int, side int, doc_id long"))
        known = rows.select("doc_id", "component", "sketch").distinct()
        last = cut(dealt(asked.join(known, "doc_id").join(sets, "doc_id")).mapInArrow(_linked(percent), "a long, b long"))
        if not last.isEmpty():
            comp = cut(components(links.unionByName(last)))

    classes = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("found"))
    out = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def one_of_each(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents that are the first of their class, with all their columns."""
    gone = _few(cut(near_duplicates(documents, shingle, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()))
    return documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
