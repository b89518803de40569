"""Queries over documents, benchmark and embeddings: text functions, retrieval, reranking, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import hash_embedding
from ..operators import answers, evidence, questions, rerank, retrieval
from .tables import table

#: The coarse tokens of a column, in SQL (the tables hold no CJK text).
TOKENS = r"regexp_extract_all(lower({c}), '[\x{{4e00}}-\x{{9fff}}]+|[a-z0-9_]+')"
#: Unicode white space as the JVM knows it.
SQL_TOK = TOKENS.format(c="text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, collection_name, doc_source, content."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("collection_name"), F.col("lang").alias("doc_source"), F.col("text").alias("content"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as questions those whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("question_vector"))


# ---- text functions -------------------------------------------------------


def text_normalized(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.normalize_whitespace(F.col("text"))).alias("kept_lines"), F.md5(X.normalize_whitespace(F.col("text"), False)).alias("flat"))


TEXT_NORMALIZED = r"""
SELECT doc_id,
  md5(array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), chr(10)),
      lambda x: trim(regexp_replace(x, '[ \t\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS kept_lines,
  md5(trim(replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t\f\x0B]+', ' ', 'g'), chr(10), ' '))) AS flat
FROM documents"""


def text_tokens(spark, sf_dir):
    t = X.coarse_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), X.token_count(F.col("text")).alias("token_count"), F.size(X.word_set(F.col("text"))).alias("n_words"))


TEXT_TOKENS = rf"""
SELECT doc_id, CAST(len({SQL_TOK}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({SQL_TOK})) AS INTEGER) AS n_distinct,
  CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS token_count,
  CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))) AS INTEGER) AS n_words
FROM documents"""


def text_facts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.years(t)).alias("n_years"), F.size(X.numbers(t)).alias("n_numbers"), X.page_hint(t).alias("page_hint"), X.short_id("doc_", F.col("source"), t).alias("short_id"), X.cache_key(F.col("source"), F.col("lang"), F.col("doc_id")).alias("cache_key"))


TEXT_FACTS = r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:19|20)[0-9]{2}')) AS INTEGER) AS n_years,
  CAST(len(regexp_extract_all(text, '-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?')) AS INTEGER) AS n_numbers,
  CAST(nullif(regexp_extract(lower(text), '(?:page|p|第)\s*([0-9]{1,4})', 1), '') AS INTEGER) AS page_hint,
  'doc_' || substr(sha1(coalesce(source, '') || '|' || text), 1, 16) AS short_id,
  sha256(concat_ws(chr(31), coalesce(source, ''), coalesce(lang, ''), CAST(doc_id AS VARCHAR))) AS cache_key
FROM documents"""


def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(X.exact_key(F.col("text"))).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


EXACT_DUPLICATES = r"""
SELECT md5(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g')) AS key, min(doc_id) AS first_doc, count(*) AS n_docs
FROM documents GROUP BY 1"""


def embedded_by_hash(spark, sf_dir):
    cells = hash_embedding(table(spark, sf_dir, "documents"), "doc_id", X.coarse_tokens(F.col("text")))
    return cells.groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"), F.round(F.max(F.abs("weight")), 6).alias("largest"))


EMBEDDED_BY_HASH = rf"""
WITH t AS (SELECT doc_id, unnest({SQL_TOK}) AS term FROM documents),
n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2),
p AS (SELECT doc_id, n, CAST('0x' || substr(sha256(term), 62, 3) AS INTEGER) AS tail FROM n),
c AS (SELECT doc_id, tail % 1024 AS bucket, sum(CASE WHEN (tail & 256) = 0 THEN n ELSE -n END) AS v FROM p GROUP BY 1, 2 HAVING sum(CASE WHEN (tail & 256) = 0 THEN n ELSE -n END) <> 0),
w AS (SELECT doc_id, v / sqrt(sum(CAST(v * v AS DOUBLE)) OVER (PARTITION BY doc_id)) AS weight FROM c)
SELECT doc_id, count(*) AS n_cells, round(sum(weight * weight), 6) AS norm, round(max(abs(weight)), 6) AS largest FROM w GROUP BY doc_id"""


# ---- corpus statistics and retrieval ---------------------------------------


def term_document_frequency(spark, sf_dir):
    return retrieval.document_frequencies(corpus(spark, sf_dir))


TERM_DF = rf"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({SQL_TOK}) AS term FROM documents) GROUP BY term"


def term_frequency_top(spark, sf_dir):
    tf = retrieval.term_frequencies(corpus(spark, sf_dir))
    return tf.groupBy("chunk_id", "dl").agg(F.max("tf").alias("most"), F.count("*").alias("n_terms"))


TERM_TF = rf"""
WITH t AS (SELECT doc_id AS chunk_id, len({SQL_TOK}) AS dl, unnest({SQL_TOK}) AS term FROM documents),
n AS (SELECT chunk_id, dl, term, count(*) AS tf FROM t GROUP BY 1, 2, 3)
SELECT chunk_id, CAST(dl AS INTEGER) AS dl, max(tf) AS most, count(*) AS n_terms FROM n GROUP BY 1, 2"""


def length_statistics(spark, sf_dir):
    return retrieval.length_stats(corpus(spark, sf_dir), "collection_name")


LENGTHS = rf"SELECT source AS collection_name, count(*) AS n_docs, CAST(sum(len({SQL_TOK})) AS BIGINT) AS n_tokens, round(avg(len({SQL_TOK})), 6) AS avg_dl FROM documents GROUP BY source"


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), 10)


def _bm25_sql(key: str = "", k: int = 10) -> str:
    c, on, part = (f"{key}, ", f" AND p.{key} = x.{key}", f"qid, {key}") if key else ("", "", "qid")
    group = f"GROUP BY {key}" if key else ""
    join_stats = f"JOIN s0 s ON s.{key} = p.{key}" if key else "CROSS JOIN s0"
    return rf"""
d0 AS (SELECT doc_id AS chunk_id, source AS collection_name, {SQL_TOK} AS tokens FROM documents),
s0 AS (SELECT {c}count(*) AS n, avg(len(tokens)) AS avg_dl FROM d0 {group}),
q0 AS (SELECT DISTINCT item_id AS qid, unnest({SQL_TOK}) AS term FROM benchmark),
t0 AS (SELECT {c}chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM d0),
p0 AS (SELECT {c}chunk_id, dl, term, count(*) AS tf FROM t0 WHERE term IN (SELECT term FROM q0) GROUP BY ALL),
x0 AS (SELECT {c}term, count(*) AS df FROM p0 GROUP BY ALL),
w0 AS (SELECT {"p." + c if key else ""}p.chunk_id, p.term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / greatest(avg_dl, 1e-6))) AS part
      FROM p0 p JOIN x0 x ON p.term = x.term{on} {join_stats}),
r0 AS (SELECT qid, {c}chunk_id, round(sum(part), 8) AS bm25_raw FROM w0 JOIN q0 USING (term) GROUP BY ALL HAVING round(sum(part), 8) > 0),
bm AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY bm25_raw DESC, chunk_id) AS rank, max(bm25_raw) OVER (PARTITION BY {part}) AS most FROM r0),
hits AS (SELECT qid, {c}chunk_id, bm25_raw, round(bm25_raw / most, 8) AS bm25_score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= {k})"""


BM25 = f"WITH {_bm25_sql()} SELECT * FROM hits"


def bm25_by_collection(spark, sf_dir):
    return retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), 3, keys=("collection_name",))


BM25_BY = f"WITH {_bm25_sql('collection_name', 3)} SELECT * FROM hits"


def overlap_topk(spark, sf_dir):
    return retrieval.overlap(corpus(spark, sf_dir), asked(spark, sf_dir), 10)


OVERLAP = rf"""
WITH q AS (SELECT DISTINCT item_id AS qid, unnest({SQL_TOK}) AS term FROM benchmark),
qs AS (SELECT qid, count(*) AS q_size FROM q GROUP BY qid),
d AS (SELECT DISTINCT doc_id AS chunk_id, unnest({SQL_TOK}) AS term FROM documents),
ds AS (SELECT chunk_id, count(*) AS d_size FROM d GROUP BY chunk_id),
h AS (SELECT qid, chunk_id, count(*) AS hits FROM q JOIN d USING (term) GROUP BY 1, 2),
s AS (SELECT qid, chunk_id, round(least(1.0, 0.7 * hits / q_size + 0.3 * hits / d_size), 8) AS score FROM h JOIN qs USING (qid) JOIN ds USING (chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0.05)
SELECT qid, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def dense_topk(spark, sf_dir):
    return retrieval.dense(*vectors(spark, sf_dir), 10)


_DENSE_SQL = """
ds AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS dense_score
      FROM embeddings v CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, chunk_id) AS rank FROM ds),
dense AS (SELECT qid, chunk_id, dense_score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 10)"""
DENSE = f"WITH {_DENSE_SQL} SELECT * FROM dense"


def dense_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    same = v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("question_vector"), "label")
    from ..functions.vectors import cosine

    scored = same.join(F.broadcast(q) if q.count() <= retrieval.BROADCAST_ROWS else q, "label").select("qid", "chunk_id", F.round(cosine(F.col("vector"), F.col("question_vector")), 6).alias("dense_score"))
    return retrieval.top(scored, 5, F.col("dense_score"), "qid")


DENSE_FILTERED = """
WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS dense_score
  FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, chunk_id) AS rank FROM s)
SELECT qid, chunk_id, dense_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


# ---- merge, rerank, evidence -------------------------------------------------


def routes(spark, sf_dir):
    b = bm25_topk(spark, sf_dir).select("qid", "chunk_id", F.lit("bm25").alias("route"), F.col("bm25_score").alias("score"))
    d = dense_topk(spark, sf_dir).select("qid", "chunk_id", F.lit("dense").alias("route"), F.col("dense_score").alias("score"))
    return b, d


def hybrid_merge(spark, sf_dir):
    out = retrieval.merged(*routes(spark, sf_dir))
    return out.withColumn("source_channels", F.array_join("source_channels", ","))


_MERGED_SQL = f"""{_bm25_sql()}, {_DENSE_SQL},
u AS (SELECT qid, chunk_id, 'bm25' AS route, bm25_score AS score FROM hits UNION ALL SELECT qid, chunk_id, 'dense', dense_score FROM dense),
merged AS (SELECT qid, chunk_id, coalesce(max(score) FILTER (WHERE route = 'dense'), 0.0) AS dense_score, coalesce(max(score) FILTER (WHERE route = 'bm25'), 0.0) AS bm25_score, 0.0::DOUBLE AS table_route_score,
  greatest(coalesce(max(score) FILTER (WHERE route = 'dense'), 0.0), coalesce(max(score) FILTER (WHERE route = 'bm25'), 0.0)) AS retrieval_score,
  concat_ws(',', CASE WHEN bool_or(route = 'dense') THEN 'dense' END, CASE WHEN bool_or(route = 'bm25') THEN 'bm25' END) AS source_channels
  FROM u GROUP BY qid, chunk_id)"""
HYBRID_MERGE = f"WITH {_MERGED_SQL} SELECT * FROM merged"


def normalized_scores(spark, sf_dir):
    m = retrieval.merged(*routes(spark, sf_dir))
    return m.select("qid", "chunk_id", F.round(rerank.min_max("dense_score", "qid"), 8).alias("dense_norm"), F.round(rerank.min_max("bm25_score", "qid"), 8).alias("bm25_norm"), F.round(rerank.relative("retrieval_score", "qid"), 8).alias("final_score"))


def _norm_sql(c: str) -> str:
    w = "OVER (PARTITION BY qid)"
    return f"round(CASE WHEN max({c}) {w} <= 0 OR {c} <= 0 THEN 0.0 WHEN max({c}) {w} = min({c}) {w} THEN 1.0 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END, 8)"


NORMALIZED = f"""WITH {_MERGED_SQL} SELECT qid, chunk_id, {_norm_sql('dense_score')} AS dense_norm, {_norm_sql('bm25_score')} AS bm25_norm,
  round(CASE WHEN max(retrieval_score) OVER (PARTITION BY qid) = min(retrieval_score) OVER (PARTITION BY qid) THEN 1.0 ELSE (retrieval_score - min(retrieval_score) OVER (PARTITION BY qid)) / (max(retrieval_score) OVER (PARTITION BY qid) - min(retrieval_score) OVER (PARTITION BY qid)) END, 8) AS final_score FROM merged"""


def fused_scores(spark, sf_dir):
    m = retrieval.merged(*routes(spark, sf_dir)).join(corpus(spark, sf_dir), "chunk_id")
    hit = (F.col("doc_source") == "en").cast("double")
    f = retrieval.fused(m, (0.55, 0.25, 0.15, 0.05), hit, F.lit(0.0))
    return retrieval.top(f, 5, F.col("final_score"), "qid").select("qid", "chunk_id", "final_score", "rank")


FUSED = f"""WITH {_MERGED_SQL},
f AS (SELECT qid, chunk_id, round(0.55::DOUBLE * dense_score + 0.25::DOUBLE * bm25_score + 0.15::DOUBLE * CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 7) AS final_score FROM merged JOIN documents ON doc_id = chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, chunk_id) AS rank FROM f)
SELECT qid, chunk_id, final_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


def candidates(spark, sf_dir):
    """BM25 hits with their questions, texts and places in a source."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_source"), F.col("text").alias("content"), F.col("lang"))
    hits = bm25_topk(spark, sf_dir)
    return retrieval.small(hits.join(asked(spark, sf_dir), "qid")).join(d, "chunk_id").withColumn("retrieval_score", F.col("bm25_score"))


def greedy_dedupe(spark, sf_dir):
    return rerank.deduplicated(candidates(spark, sf_dir))


def metadata_boosts(spark, sf_dir):
    c = candidates(spark, sf_dir)
    boost = rerank.metadata_boost(F.col("question"), F.col("content"), [F.col("lang")], F.col("doc_source"), (F.col("chunk_id") % 7).cast("int"), F.lit(3))
    return c.select("qid", "chunk_id", F.round(boost, 8).alias("metadata_boost"))


def _overlap_sql(a: str, b: str) -> str:
    x, y = TOKENS.format(c=a), TOKENS.format(c=b)
    i = f"len(list_intersect(list_distinct({x}), list_distinct({y})))"
    return f"CASE WHEN {i} > 0 THEN least(1.0, 0.7 * {i} / greatest(len(list_distinct({x})), 1) + 0.3 * {i} / greatest(len(list_distinct({y})), 1)) ELSE 0.0 END"


BOOSTS = f"""WITH {_bm25_sql()}
SELECT qid, chunk_id, round(least(1.0, 0.35 * ({_overlap_sql('b.text', 'd.text')}) + 0.20 * ({_overlap_sql('b.text', 'd.source')}) + 0.15 * ({_overlap_sql('b.text', 'd.lang')})
  + CASE WHEN abs(chunk_id % 7 - 3) <= 1 THEN 0.20 ELSE 0.0 END), 8) AS metadata_boost
FROM hits JOIN benchmark b ON item_id = qid JOIN documents d ON doc_id = chunk_id"""


def protected_pool(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("source_channels", F.array(F.lit("bm25")))
    return rerank.protected(c, X.token_overlap(X.coarse_tokens(F.col("question")), X.coarse_tokens(F.col("content"))), 2, 40)


PROTECTED = f"""WITH {_bm25_sql()},
l AS (SELECT qid, chunk_id, bm25_score, {_overlap_sql('b.text', 'd.text')} AS lexical FROM hits JOIN benchmark b ON item_id = qid JOIN documents d ON doc_id = chunk_id),
p AS (SELECT qid, chunk_id, round(0.75 * bm25_score + 0.20 * lexical + 0.05, 8) AS protection_score FROM l WHERE bm25_score >= 0.45 AND lexical >= 0.04),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY protection_score DESC, chunk_id) AS n FROM p)
SELECT qid, chunk_id, protection_score FROM r WHERE n <= 12"""


def quota_topk(spark, sf_dir):
    """Hits in Spanish and German stand for tables, to fill the quota."""
    c = candidates(spark, sf_dir).withColumns({"query_type": F.lit("table_qa"), "chunk_type": F.when(F.col("lang").isin("es", "de"), "table").otherwise("text"), "rank_score": F.col("retrieval_score")})
    return rerank.with_table_quota(c, 5, 2).select("qid", "chunk_id", "chunk_type", "place")


QUOTA = f"""WITH {_bm25_sql()},
c AS (SELECT qid, chunk_id, bm25_score, CASE WHEN lang IN ('es', 'de') THEN 'table' ELSE 'text' END AS chunk_type FROM hits JOIN documents ON doc_id = chunk_id),
f AS (SELECT *, chunk_type = 'table' AND row_number() OVER (PARTITION BY qid, chunk_type ORDER BY bm25_score DESC, chunk_id) <= 2 AS first FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first DESC, bm25_score DESC, chunk_id) AS place FROM f)
SELECT qid, chunk_id, chunk_type, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5"""


def neighbour_supplement(spark, sf_dir):
    """Ids stand for places: ten to a document, five to a page."""
    c = corpus(spark, sf_dir).select("chunk_id", F.floor(F.col("chunk_id") / 10).alias("doc_id"), F.floor(F.col("chunk_id") % 10 / 5).alias("page_idx"), (F.col("chunk_id") % 10).alias("chunk_index"))
    ranked = retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), 40).select("qid", "chunk_id", F.col("bm25_score").alias("retrieval_score"), "rank").join(c, "chunk_id")
    return rerank.neighbours(ranked.where("rank <= 5"), ranked)


NEIGHBOURS = f"""WITH {_bm25_sql(k=40)},
h AS (SELECT qid, chunk_id, bm25_score, rank, chunk_id // 10 AS doc, (chunk_id % 10) // 5 AS page, chunk_id % 10 AS place FROM hits),
n AS (SELECT s.qid, s.chunk_id AS seed, o.chunk_id, o.bm25_score FROM h s JOIN h o ON s.qid = o.qid AND s.doc = o.doc AND s.page = o.page AND abs(s.place - o.place) <= 1 WHERE s.rank <= 5 AND o.rank > 5),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, seed ORDER BY bm25_score DESC, chunk_id) AS r FROM n)
SELECT qid, seed, chunk_id, round(least(1.0, bm25_score + 0.02), 8) AS score FROM r WHERE r = 1"""


def _evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("content"), F.when(F.col("lang") == "de", "table").otherwise("text").alias("chunk_type"))
    return retrieval.small(bm25_topk(spark, sf_dir).where("rank <= 5").select("qid", "chunk_id", F.col("bm25_score").alias("score"), "rank")).join(d, "chunk_id")


def gate_diagnostics(spark, sf_dir):
    return evidence.diagnostics(_evidence(spark, sf_dir))


_EVIDENCE_SQL = f"""{_bm25_sql()},
e AS (SELECT qid, chunk_id, bm25_score AS score, rank, source AS doc_id, text AS content, CASE WHEN lang = 'de' THEN 'table' ELSE 'text' END AS chunk_type FROM hits JOIN documents ON documents.doc_id = chunk_id WHERE rank <= 5)"""
GATE_DIAGNOSTICS = f"""WITH {_EVIDENCE_SQL}
SELECT qid, count(*) AS n_rows, round(max(score), 4) AS top_score, round(avg(score), 4) AS avg_score, CASE WHEN max(score) < 0.45 OR avg(score) < 0.30 THEN 'low_score' ELSE '' END AS score_warning,
  count(DISTINCT doc_id) AS doc_count, count(*) FILTER (WHERE chunk_type = 'table') AS table_count, round((max(score) + avg(score)) / 2, 4) AS confidence
FROM e GROUP BY qid"""


def gate_decisions(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, "table_qa").otherwise("multi_doc_compare").alias("query_type"))
    return evidence.gate(q, _evidence(spark, sf_dir))


GATE = f"""WITH {_EVIDENCE_SQL},
g AS (SELECT qid, count(DISTINCT doc_id) AS docs, count(*) FILTER (WHERE chunk_type = 'table') AS tables, round((max(score) + avg(score)) / 2, 4) AS confidence FROM e GROUP BY qid)
SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'table_qa' ELSE 'multi_doc_compare' END AS query_type, CASE WHEN docs IS NULL THEN 'retry' ELSE 'answer' END AS decision,
  CASE WHEN docs IS NULL THEN 'no_evidence' ELSE 'evidence_available' END AS reason, coalesce(confidence, 0.0) AS confidence,
  CASE WHEN docs IS NULL THEN '' WHEN item_id % 2 = 0 AND tables < 1 THEN 'missing_table_evidence' WHEN item_id % 2 = 1 AND docs < 2 THEN 'multi_doc_evidence_missing' ELSE '' END AS coverage_warnings
FROM benchmark LEFT JOIN g ON item_id = qid"""


def citation_payload(spark, sf_dir):
    return evidence.citations(_evidence(spark, sf_dir))


CITATIONS = f"""WITH {_EVIDENCE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS n FROM e)
SELECT qid, chunk_id, 'E' || n AS evidence_id, 'C' || n AS citation_id, CAST(n AS INTEGER) AS rank, substr(content, 1, 240) AS quote, round(score, 6) AS confidence FROM n"""


def compare_sources(spark, sf_dir):
    return evidence.first_of_each_source(_evidence(spark, sf_dir).withColumnRenamed("doc_id", "doc_source"))


COMPARE = f"WITH {_EVIDENCE_SQL} SELECT qid, doc_id AS doc_source, arg_min(chunk_id, rank) AS chunk_id, min(rank) AS rank FROM e GROUP BY 1, 2"


def answer_evaluation(spark, sf_dir):
    e = _evidence(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"), F.min_by("content", "rank").alias("content"))
    answer = F.col("content")
    decision = F.when(F.col("qid") % 3 == 0, "refuse").when(F.col("qid") % 3 == 1, "clarify").otherwise("answer")
    return e.select("qid", *[c.alias(k) for k, c in evidence.evaluation(answer, decision, F.lit(2), F.col("n")).items()])


EVALUATION = f"""WITH {_EVIDENCE_SQL}, a AS (SELECT qid, count(*) AS n, arg_min(content, rank) AS answer, qid % 3 AS m FROM e GROUP BY qid),
s AS (SELECT qid, CASE WHEN m = 1 THEN 1.0 ELSE least(1.0, 2.0 / n) END AS g, CASE m WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE least(1.0, length(answer) / 120.0) END AS c FROM a)
SELECT qid, round(g, 4) AS grounding_score, round(c, 4) AS completeness_score, 1.0::DOUBLE AS consistency_score, round((g + c + 1.0) / 3.0, 4) AS overall_score FROM s"""


def recall_of_keywords(spark, sf_dir):
    """Share of the words of a question that its evidence has."""
    e = _evidence(spark, sf_dir).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), " ").alias("evidence"))
    k = F.array_distinct(X.coarse_tokens(F.col("question")))
    return asked(spark, sf_dir).join(e, "qid", "left").select("qid", F.round(evidence.keyword_recall(k, F.col("evidence")), 6).alias("recall"))


RECALL = rf"""WITH {_EVIDENCE_SQL}, v AS (SELECT qid, lower(string_agg(content, ' ' ORDER BY rank)) AS evidence FROM e GROUP BY qid),
w AS (SELECT item_id AS qid, list_distinct({TOKENS.format(c='text')}) AS k FROM benchmark)
SELECT w.qid, round(len(list_filter(k, lambda x: contains(coalesce(evidence, ''), x))) * 1.0 / len(k), 6) AS recall FROM w LEFT JOIN v ON w.qid = v.qid"""


def question_variants(spark, sf_dir):
    u = questions.understood(asked(spark, sf_dir))
    return u.select("qid", "query_type", F.size("variants").alias("n_variants"), F.array_join("variants", " || ").alias("variants"), F.array_join("missing", ",").alias("missing"), "decision")


def gold_summary(spark, sf_dir):
    """Whether a question's best hit holds it, and how scores and misses spread."""
    b = asked(spark, sf_dir)
    hits = retrieval.small(bm25_topk(spark, sf_dir).where("rank = 1")).join(corpus(spark, sf_dir), "chunk_id").join(b, "qid")
    found = F.contains(F.col("content"), F.col("question"))
    return hits.agg(F.count("*").alias("n_questions"), F.round(F.avg(found.cast("int")), 6).alias("accuracy"), F.round(F.avg("bm25_raw"), 6).alias("mean_score"))


GOLD = f"""WITH {_bm25_sql()} SELECT count(*) AS n_questions, round(avg(CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(bm25_raw), 6) AS mean_score
FROM hits JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = qid WHERE rank = 1"""

def numeric_conflicts(spark, sf_dir):
    return answers.numeric_conflict(_evidence(spark, sf_dir).withColumn("query_type", F.lit("table_qa")))


CONFLICTS = rf"""WITH {_EVIDENCE_SQL}, n AS (SELECT qid, unnest(list_slice(regexp_extract_all(content, '-?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?%?'), 1, 2)) AS number FROM e),
c AS (SELECT qid, count(DISTINCT number) AS n FROM n GROUP BY qid)
SELECT DISTINCT e.qid, coalesce(n, 0) >= 3 AS conflict_detected FROM e LEFT JOIN c ON e.qid = c.qid"""


def answer_places(spark, sf_dir):
    e = _evidence(spark, sf_dir).join(asked(spark, sf_dir), "qid")
    rows = e.select("qid", "chunk_id", "question", F.col("doc_id").alias("doc_source"), F.lit("").alias("heading_path"), (F.col("chunk_id") % 9).cast("int").alias("page_idx"), (F.col("chunk_id") % 4).cast("int").alias("chunk_index"), F.lit("").alias("content"), "score")
    return answers.answer_order(rows).select("qid", "chunk_id", "place")


PLACES = f"""WITH {_EVIDENCE_SQL}
SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY doc_id, chunk_id % 9, chunk_id % 4, score DESC, chunk_id) AS INTEGER) AS place FROM e"""


def _typed(spark, sf_dir):
    return questions.understood(asked(spark, sf_dir))


def evidence_audit(spark, sf_dir):
    rows = _evidence(spark, sf_dir)
    gates = evidence.gate(_typed(spark, sf_dir), rows)
    a = answers.merged_gate(gates, answers.audited(_typed(spark, sf_dir), rows))
    return a.select("qid", "query_type", "rule_decision", "decision", F.array_join("missing_aspects", ",").alias("missing_aspects"), "evidence_coverage")


def answer_texts(spark, sf_dir):
    rows = _evidence(spark, sf_dir).withColumn("doc_source", F.col("doc_id"))
    a = answers.answered(_typed(spark, sf_dir), rows)
    return a.select("qid", "query_type", F.md5("answer").alias("answer"), "confidence")


ANSWERS = f"""WITH {_EVIDENCE_SQL}
SELECT qid, 'fact_lookup' AS query_type, md5('{answers.HEADS["fact"]}' || chr(10) || string_agg('- ' || content || ' [C' || rank || ']', chr(10) ORDER BY rank)) AS answer, round(max(score), 4) AS confidence FROM e GROUP BY qid"""


def focused_snippets(spark, sf_dir):
    e = _evidence(spark, sf_dir).join(asked(spark, sf_dir), "qid")
    s = answers.focused_snippet(F.col("question"), F.col("content"), F.col("chunk_type") == "table")
    return e.select("qid", "chunk_id", F.length(s).alias("n_chars"), F.md5(s).alias("digest"))


QUERIES = {
    "numeric_conflict": (numeric_conflicts, CONFLICTS),
    "answer_order": (answer_places, PLACES),
    "rule_audit": (evidence_audit, None),
    "answer_texts": (answer_texts, ANSWERS),
    "snippet_window": (focused_snippets, None),
    "text_normalized": (text_normalized, TEXT_NORMALIZED),
    "text_tokens": (text_tokens, TEXT_TOKENS),
    "text_facts": (text_facts, TEXT_FACTS),
    "exact_duplicates": (exact_duplicates, EXACT_DUPLICATES),
    "hash_embeddings": (embedded_by_hash, EMBEDDED_BY_HASH),
    "term_df": (term_document_frequency, TERM_DF),
    "term_tf": (term_frequency_top, TERM_TF),
    "doc_len_stats": (length_statistics, LENGTHS),
    "bm25_topk": (bm25_topk, BM25),
    "bm25_by_source": (bm25_by_collection, BM25_BY),
    "overlap_rank": (overlap_topk, OVERLAP),
    "dense_topk": (dense_topk, DENSE),
    "dense_filtered": (dense_filtered, DENSE_FILTERED),
    "hybrid_merge": (hybrid_merge, HYBRID_MERGE),
    "minmax_norm": (normalized_scores, NORMALIZED),
    "hybrid_intent_fusion": (fused_scores, FUSED),
    "greedy_dedupe": (greedy_dedupe, None),
    "metadata_boost": (metadata_boosts, BOOSTS),
    "protected_pool": (protected_pool, PROTECTED),
    "quota_topk": (quota_topk, QUOTA),
    "neighbour_supplement": (neighbour_supplement, NEIGHBOURS),
    "gate_diagnostics": (gate_diagnostics, GATE_DIAGNOSTICS),
    "gate_decisions": (gate_decisions, GATE),
    "citations_payload": (citation_payload, CITATIONS),
    "compare_first": (compare_sources, COMPARE),
    "eval_metrics": (answer_evaluation, EVALUATION),
    "keyword_recall": (recall_of_keywords, RECALL),
    "expand_variants": (question_variants, None),
    "gold_summary": (gold_summary, GOLD),
}
