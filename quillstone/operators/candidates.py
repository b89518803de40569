"""Candidates of questions (qid, chunk_id, scores, texts): one shape, one score, one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, clean, clip01, first_non_empty, normalize_whitespace, short_id

# The score columns by which a gate and an answer judge a row, the first that is there.
GATE_SCORES = ("light_final_score", "confidence_score", "final_score", "score", "dense_score", "bm25_score")
ANSWER_SCORES = ("confidence_score", "final_score", "score")
#: The fields in which a keyword may be found.
SEARCHED = ("heading_path", "level1_title", "level2_title", "level3_title", "table_header_text", "table_context_text")
#: The columns of a candidate, with their types.
FIELDS = {"chunk_id": "string", "doc_id": "string", "collection_name": "string", "doc_source": "string", "content": "string", "page_idx": "int", "page_range": "string", "chunk_type": "string", "chunk_index": "int", "heading_path": "string", "level1_title": "string", "level2_title": "string", "level3_title": "string", "table_header_text": "string", "table_context_text": "string"}
#: What a response tells of a hit.
RESPONSE = ("chunk_id", "doc_id", "doc_source", "page_idx", "page_range", "chunk_type", "heading_path", "content", "score", "rank", "citation")


def score_of(rows: DataFrame, names: tuple[str, ...] = GATE_SCORES) -> tuple[Column, Column]:
    """(score in [0, 1], the column that it comes from) of the first of the score columns that has a value; 0 and '' without."""
    held = [n for n in names if n in rows.columns]
    score = F.coalesce(*[F.when(F.col(n).isNotNull(), clip01(F.col(n).cast("double"))) for n in held], F.lit(0.0))
    source = F.coalesce(*[F.when(F.col(n).isNotNull(), n) for n in held], F.lit(""))
    return score, source


def recall_score(rows: DataFrame) -> Column:
    """The hybrid score, else the retrieval score, else the best of the routes."""
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in rows.columns else F.lit(0.0)
    for n in ("hybrid_recall_score", "retrieval_score"):
        if n in rows.columns:
            return clip01(zero(n))
    return clip01(F.greatest(zero("dense_score"), zero("bm25_score"), zero("table_route_score")))


def fallback(rows: DataFrame) -> DataFrame:
    """Rows as they rank without a model: every score is the recall score."""
    s = recall_score(rows)
    return rows.withColumn("hybrid_recall_score", s).withColumns({n: F.col("hybrid_recall_score") for n in ("rank_score", "confidence_score", "final_score")}).withColumn("score_source", F.lit("hybrid_recall_score"))


def candidate_key(chunk_id: Column, text: Column) -> Column:
    """The chunk's id, or one made from its text."""
    return F.coalesce(clean(chunk_id.cast("string")), short_id("anon-", text))


def search_text(rows: DataFrame) -> Column:
    """All that a keyword may be found in: headings, table texts and the content."""
    own = [F.coalesce(F.col(n), F.lit("")) if n in rows.columns else F.lit("") for n in SEARCHED]
    text = first_non_empty(*[F.col(n) for n in ("raw_doc", "content") if n in rows.columns])
    return F.trim(F.concat_ws(" ", *own, text))


def pair_text(rows: DataFrame) -> Column:
    """What a pair model reads: the distinct fields that aren't empty, a line each."""
    names = [n for n in (*SEARCHED[:4], "doc_source", *SEARCHED[4:]) if n in rows.columns]
    text = first_non_empty(*[F.col(n) for n in ("raw_doc", "content") if n in rows.columns])
    flat = F.transform(F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names], text), lambda x: normalize_whitespace(x, False))
    return F.array_join(F.array_distinct(F.filter(flat, lambda x: x != "")), "\n")


def coerced(rows: DataFrame) -> DataFrame:
    """Rows of any source as candidates: the columns of FIELDS, missing ones null; an id from chunk_id, id or _id, or a hash of the text."""
    text = first_non_empty(*[F.col(n) for n in ("raw_doc", "content", "text") if n in rows.columns])
    ids = [clean(F.col(n).cast("string")) for n in ("chunk_id", "id", "_id") if n in rows.columns]
    special = {"chunk_id": F.coalesce(*ids, short_id("hash_", text)), "content": text, "chunk_type": F.coalesce(clean(F.col("chunk_type")), F.lit("text")) if "chunk_type" in rows.columns else F.lit("text")}
    return rows.select(*[k for k in ("qid",) if k in rows.columns], *[special.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in FIELDS.items()])


def merged_pools(k: int, *pools: DataFrame) -> DataFrame:
    """qid, chunk_id, pool, place: of ranked pools (qid, chunk_id, rank) the first k rows of each question; earlier pools go first, and a row counts once."""
    rows = reduce(DataFrame.unionByName, [p.select("qid", "chunk_id", "rank", F.lit(i).alias("pool")) for i, p in enumerate(pools)])
    first = rows.groupBy("qid", "chunk_id").agg(F.min(F.struct("pool", "rank")).alias("f")).select("qid", "chunk_id", "f.*")
    w = Window.partitionBy("qid").orderBy("pool", "rank", "chunk_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("qid", "chunk_id", "pool", "place")


def share_of_most(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows with the column as a share of its largest value (of the keys); 0 where that isn't positive."""
    most = rows.groupBy(*keys).agg(F.max(name).alias("__most"))
    both = rows.join(most, list(keys)) if keys else rows.crossJoin(F.broadcast(most))  # one row
    return both.withColumn(f"{name}_share", F.when(F.col("__most") > 0, F.col(name) / F.col("__most")).otherwise(0.0)).drop("__most")


def filled_up(kept: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """qid, chunk_id, place: the rows that a deduplication kept, then, while there are fewer than limit, the others in their order (qid, chunk_id, rank)."""
    return merged_pools(limit, kept.join(ranked.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"]), ranked).select("qid", "chunk_id", "place")


def response(rows: DataFrame) -> DataFrame:
    """The hits of a response: the columns of RESPONSE that rows has, sources by their file names."""
    label = F.concat(F.lit("C"), F.col("rank")).alias("citation")
    return rows.select("qid", *[base_name(F.col(n)).alias(n) if n == "doc_source" else label if n == "citation" else F.col(n) for n in RESPONSE if n in rows.columns or n == "citation"])


def zipped(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Evidence and citations of a question side by side, by rank; either side may be longer."""
    right = citations.select("qid", "rank", *[F.col(c).alias(f"citation_{c}") for c in citations.columns if c not in ("qid", "rank")])
    return evidence.join(right, ["qid", "rank"], "full_outer")


def residual(stages: DataFrame) -> DataFrame:
    """By request (request_id, stage, ms): the time of the stages, and what the row `total` has beyond them (not under 0)."""
    timed = F.sum(F.when(F.col("stage") != "total", F.col("ms")).otherwise(0.0))
    total = F.max(F.when(F.col("stage") == "total", F.col("ms")))
    return stages.groupBy("request_id").agg(F.round(timed, 4).alias("timed"), F.round(F.greatest(F.lit(0.0), F.coalesce(total, timed) - timed), 4).alias("residual"))
