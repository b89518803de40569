"""Incremental indexing as a stream: new files are upserted batch by batch, as a batch job would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bucket_store
from ..operators.shared import files


def stream_upserts(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], version: str, buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Upsert the Parquet files that appear under source into a bucketed table under target.

    A batch rewrites the buckets of its keys and nothing else. Its number is
    the change's tag, so a batch that is repeated after a failure changes
    nothing; versions that the newest `keep` manifests don't name are deleted.
    """
    kind = spark.createDataFrame([], schema).schema

    def write(batch: DataFrame, number: int) -> None:
        table = bucket_store.create(batch.sparkSession, target, kind, keys, buckets=buckets)
        table.upsert(batch, F.col(version), tag=f"{checkpoint}:{number}")
        table.expire(keep)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Index the chunks of sources that appear under source as Parquet: unchanged sources are skipped, changed ones replaced as a whole.

    A file holds whole sources; see BucketStore.index() for its columns.
    """
    kind = spark.createDataFrame([], schema).schema

    def write(batch: DataFrame, number: int) -> None:
        table = bucket_store.create(batch.sparkSession, target, kind, ["collection_name", "doc_source", "chunk_id"], by=bucket_store.SOURCE, buckets=buckets)
        table.index(batch, tag=f"{checkpoint}:{number}")
        table.expire(keep)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version of a streamed table, or None."""
    fs, root = files(spark, f"{target}/_settings")
    return bucket_store.load(spark, target).read() if fs.exists(root) else None


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows; works on streams (with a watermark) and batches alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
