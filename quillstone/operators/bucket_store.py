"""A keyed table of which a change rewrites only the buckets that it touches.

Rows lie in `buckets` folders by a hash of the bucket key. A change reads the
touched buckets, writes them anew under the next version, and then writes a
manifest: the version of each bucket, a row each. Readers take the newest
complete manifest, so a change is there as a whole or not at all, and a failed
one leaves nothing but files that no manifest names. expire() deletes those and
the versions that only old manifests name.

A change may carry a tag (a stream's batch). If the newest manifest has the same
tag, the change has been made and nothing is written, which makes a repeated
batch harmless. There is one writer at a time.

Rows of a hot bucket are split among files (a rebalance by bucket), and the
rows that a change replaces meet it by shuffled joins, not in a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import files, written
from .store import plan, upserted

#: What indexing compares of a source.
SOURCE = ("collection_name", "doc_source")


@dataclass(frozen=True)
class Manifest:
    """Versions of the buckets that hold rows, and the tag of the change that wrote them."""

    number: int
    versions: dict[int, int]
    tag: str | None


@dataclass(frozen=True)
class BucketStore:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    by: tuple[str, ...]
    buckets: int
    schema: StructType

    # ---- reading ----------------------------------------------------------

    def manifests(self) -> list[int]:
        fs, root = files(self.spark, f"{self.path}/_manifest")
        if not fs.exists(root):
            return []
        made = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getPath().getName()) for p in fs.listStatus(root) if fs.exists(made(p.getPath(), "_SUCCESS")))

    def manifest(self, number: int | None = None) -> Manifest:
        """The newest manifest, or one of those that are kept."""
        there = self.manifests()
        if not there:
            return Manifest(0, {}, None)
        number = there[-1] if number is None else number
        rows = self.spark.read.schema("bucket int, version long, tag string").parquet(f"{self.path}/_manifest/{number}").collect()  # a row for each bucket
        return Manifest(number, {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, next((r["tag"] for r in rows), None))

    def read(self, number: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The table, as of a manifest, or some of its buckets."""
        return self._rows(self.manifest(number), only)

    def _rows(self, found: Manifest, only: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/bucket={b}/v={v}" for b, v in sorted(found.versions.items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most one for each bucket

    # ---- changes ------------------------------------------------------------

    def change(self, incoming: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None) -> list[int]:
        """Replace the rows of the buckets that incoming touches by how(stored rows of them, incoming); the buckets."""
        before = self.manifest()
        if tag is not None and before.tag == tag:
            return []
        touched = self.touched(incoming)
        if touched:
            self._write(how(self._rows(before, touched), incoming), before, touched, tag)
        return touched

    def _write(self, rows: DataFrame, before: Manifest, touched: list[int], tag: str | None) -> None:
        version = before.number + 1
        placed = rows.select(*self.schema.names).withColumns({"bucket": self.bucket(), "v": F.lit(version)})
        placed.hint("rebalance", "bucket").write.partitionBy("bucket", "v").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        fs, _ = files(self.spark, self.path)
        made = self.spark._jvm.org.apache.hadoop.fs.Path
        full = {b: version for b in touched if fs.exists(made(f"{self.path}/bucket={b}/v={version}"))}  # a bucket may have lost all rows
        versions = {b: v for b, v in before.versions.items() if b not in touched} | full
        named = [(b, v, tag) for b, v in versions.items()] or [(-1, version, tag)]
        self.spark.createDataFrame(named, "bucket int, version long, tag string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest/{version}")

    def upsert(self, incoming: DataFrame, version: Column, tag: str | None = None) -> list[int]:
        """One row of each key: the newest incoming one replaces the stored one."""
        return self.change(incoming, lambda stored, new: upserted(stored, new.select(*self.schema.names), list(self.keys), version), tag)

    def delete(self, keys: DataFrame, tag: str | None = None) -> list[int]:
        """Without the rows of some keys (columns that the bucket key is among)."""
        names = keys.columns
        return self.change(keys.distinct(), lambda stored, gone: stored.join(gone, names, "left_anti"), tag)

    def index(self, chunks: DataFrame, force: bool = False, tag: str | None = None) -> DataFrame:
        """Carry out the incremental plan: chunks of new sources come in, those of changed ones replace all that was stored, unchanged ones are left alone.

        chunks: rows of whole sources, with collection_name, doc_source,
        doc_hash, doc_id and indexed_at. The store's bucket key must be the
        source's, so that a source lies in one bucket. Returns the plan.
        """
        if set(self.by) != set(SOURCE):
            raise ValueError(f"index() needs a store by {SOURCE}")
        columns = [*SOURCE, "doc_hash", "doc_id", "indexed_at"]
        before = self.manifest()
        sources = chunks.groupBy(*SOURCE).agg(F.max_by("doc_hash", "indexed_at").alias("doc_hash"))
        if tag is not None and before.tag == tag:
            return sources.limit(0).select(*SOURCE, F.lit("skip").alias("action"))
        stored = self._rows(before, self.touched(chunks)).select(*columns).distinct()
        actions = written(plan(sources, stored, force).select(*SOURCE, "action"))
        changed = chunks.join(actions.where("action <> 'skip'").select(*SOURCE), list(SOURCE), "left_semi")
        self.change(changed, lambda old, new: old.join(actions.where("action = 'replace'").select(*SOURCE), list(SOURCE), "left_anti").unionByName(new.select(*self.schema.names)), tag)
        return actions

    def expire(self, keep: int = 2) -> int:
        """Delete what only manifests older than the newest `keep` name, and what none names; the number of folders."""
        there = self.manifests()
        kept = {(b, v) for n in there[-keep:] for b, v in self.manifest(n).versions.items()}
        fs, root = files(self.spark, self.path)
        gone = 0
        for folder in fs.listStatus(root):
            name = folder.getPath().getName()
            if name.startswith("bucket="):
                for v in fs.listStatus(folder.getPath()):
                    if (int(name[7:]), int(v.getPath().getName()[2:])) not in kept:
                        gone += bool(fs.delete(v.getPath(), True))
        for n in there[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{n}"), True)
        return gone


def create(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], by: Sequence[str] | None = None, buckets: int = 64) -> BucketStore:
    """A new store (or the one that is there). by: the bucket key, columns of rows (default: the keys)."""
    fs, root = files(spark, f"{path}/_settings")
    if not fs.exists(root):
        spark.createDataFrame([(list(keys), list(by or keys), buckets, schema.json())], "keys array<string>, by array<string>, buckets int, schema string").coalesce(1).write.parquet(f"{path}/_settings")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> BucketStore:
    import json

    found = spark.read.parquet(f"{path}/_settings").first()
    return BucketStore(spark, path, tuple(found["keys"]), tuple(found["by"]), found["buckets"], StructType.fromJson(json.loads(found["schema"])))
