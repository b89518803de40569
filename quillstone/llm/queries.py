"""The operators' queries over the given tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, divergence, hilbert, html_text, language_id, line_dedup, mixing, near_dedup, packing, quality, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, mod n (0 for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold(4) != 2))
    return language_id.identified(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.train(docs, labels.where(fold(5) != 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.sharded(table(spark, sf_dir, "documents"), columns=())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).drop("ids")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))[0]


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.first_doc IS NOT NULL AND k.doc_id <> f.first_doc AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_sql() -> str:
    strict, soft = ("".join(rf" + CASE WHEN regexp_matches(lower(url), '(^|[^\p{{L}}\p{{N}}]){t}([^\p{{L}}\p{{N}}]|$)') THEN 1 ELSE 0 END" for t in terms) for terms in (url_filter.STRICT, url_filter.SOFT))
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r[:2]))
    rules = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in ordered)
    verdicts = "\n".join(f"    WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in ordered)
    return rf"""
WITH parts AS (
  SELECT page_id, url,
         lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1), '')) AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
{rules}
    ELSE NULL END AS rule,
    CAST(0{strict} AS BIGINT) AS n_strict, CAST(0{soft} AS BIGINT) AS n_soft
  FROM parts)
SELECT page_id, host, path, rule,
  CASE
{verdicts}
    WHEN n_strict > 0 OR n_soft >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, n_strict * {url_filter.LIMIT} + n_soft * {url_filter.LIMIT / url_filter.SOFT_HITS}::DOUBLE AS weight
FROM ruled
"""


def op12_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds as chained common table expressions, over lists of integers."""
    step = """
m{i} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT n, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j]))) AS d
    FROM kept, c{i}) GROUP BY n, vec_id)"""
    means = """,
s{i} AS (SELECT cluster, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM m{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY cluster, j),
c{next} AS MATERIALIZED (
  SELECT c, coalesce(list(f ORDER BY j) FILTER (WHERE j IS NOT NULL), any_value(w)) AS w
  FROM c{i} LEFT JOIN (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS f FROM s{i}) ON cluster = c GROUP BY c),"""
    chained = "".join(step.format(i=i) + (means.format(i=i, next=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS w
  FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k})),{chained}
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM m{rounds} JOIN c{rounds} ON c = cluster
"""


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, source) USING (lang, source)),
full_p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lang_p AS (
  SELECT lang, term, 1 + (1000000000 * (sum(c) + 2)) // (max(total) + 2 * max(v)) AS q
  FROM full_p JOIN (SELECT lang, sum(n)::HUGEINT AS total, max(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM full_p JOIN lang_p USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_line_dedup, op3_near_dedup, op4_toxicity, op5_quality_rules, op6_decontamination, op7_hilbert_shards, op8_url_filter, op9_html_text, op10_packing, op11_source_mix, op12_centroids, op13_source_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op8_url_filter": op8_sql(), "op12_centroids": op12_sql(), "op13_source_divergence": OP13_SQL}
