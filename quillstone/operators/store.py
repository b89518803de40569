"""Changes to stored tables as DataFrame plans: upserts, replacements, deletions, incremental skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, first_non_empty, short_id
from .candidates import search_text


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row of each key: an incoming row replaces a stored one; of several incoming (or stored) ones the newest by version counts."""
    rows = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), version.desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def documents_of(chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A row for each document: of its rows the one with most pages; a stored count is never lowered."""
    pages = F.coalesce(F.col("page_count"), F.col("page_idx") + 1, F.lit(0))
    best = chunks.groupBy("doc_id").agg(F.max_by("collection_name", pages).alias("collection_name"), F.max(pages).alias("page_count"))
    if stored is None:
        return best
    old = stored.select("doc_id", F.col("page_count").alias("__pages"))
    return best.join(old, "doc_id", "left").withColumn("page_count", F.greatest("page_count", F.coalesce("__pages", F.lit(0)))).drop("__pages")


def replaced(stored: DataFrame, incoming: DataFrame, partition: str) -> DataFrame:
    """The incoming rows and the stored rows of other partitions (collections)."""
    return stored.join(incoming.select(partition).distinct(), partition, "left_anti").unionByName(incoming)


def without(stored: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the number that go, by key."""
    names = keys.columns
    return stored.join(keys.distinct(), names, "left_anti"), stored.join(keys.distinct(), names, "left_semi").groupBy(*names).agg(F.count("*").alias("n_deleted"))


def plan(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """What indexing does with each incoming source: insert, replace or skip (same hash)."""
    keys = ["collection_name", "doc_source"]
    w = Window.partitionBy(*keys).orderBy(F.col("indexed_at").desc(), F.col("doc_id").desc())
    latest = stored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, F.col("doc_hash").alias("stored_hash"))
    action = F.when(F.col("stored_hash").isNull(), "insert").when((F.col("stored_hash") == F.col("doc_hash")) & F.lit(not force), "skip").otherwise("replace")
    return incoming.join(latest, keys, "left").withColumn("action", action)


def prepared(chunks: DataFrame) -> DataFrame:
    """Chunks with ids and search texts: content is the first that is not empty, the id a hash where it is missing."""
    content = first_non_empty(F.col("raw_doc"), F.col("content"))
    out = chunks.withColumn("content", content)
    made = short_id("chunk_", F.col("collection_name"), F.col("doc_id"), F.col("chunk_index"), F.col("content"))
    return out.withColumn("chunk_id", F.coalesce(clean(F.col("chunk_id")), made)).withColumn("search_text", search_text(out))


def touched(sessions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sessions after an insert or touch: a blank collection keeps the old one."""
    new = incoming.select("session_id", F.col("collection_name").alias("__c"), F.col("updated_at").alias("__t"))
    both = sessions.join(new, "session_id", "full_outer")
    return both.select("session_id", F.coalesce(clean(F.col("__c")), "collection_name", F.lit("default")).alias("collection_name"), F.greatest("updated_at", "__t").alias("updated_at"))


def merged_metadata(old: Column, new: Column) -> Column:
    """Shallow merge of maps; new values win."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.map_contains_key(new, k), new[k]).otherwise(old[k])))


def latest_documents(documents: DataFrame) -> DataFrame:
    """Of each collection and source the document that was indexed last (of equal times the largest id)."""
    w = Window.partitionBy("collection_name", "doc_source").orderBy(F.col("indexed_at").desc(), F.col("doc_id").desc())
    return documents.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
