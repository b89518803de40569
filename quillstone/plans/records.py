"""Queries over conversations, pages, the star schema and events: sessions, questions, blocks and chunks, stores, relational work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, questions, sessions, store
from ..sources import pages
from ..streaming.indexing import windowed_counts
from .tables import table


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("place"), "role", F.col("text").alias("content"))


# ---- sessions ---------------------------------------------------------------


def session_list(spark, sf_dir):
    return sessions.listing(messages(spark, sf_dir))


_SESSIONS = """
c AS (SELECT conv_id AS session_id, count(*) AS message_count, count(*) FILTER (WHERE role = 'user') AS turn_count, max(turn) AS last_place FROM conversations GROUP BY 1),
u AS (SELECT conv_id AS session_id, arg_max(text, turn) AS last_user_question FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT conv_id AS session_id, arg_max(text, turn) AS last_answer, max(turn) AS last_answer_place FROM conversations WHERE role = 'assistant' GROUP BY 1),
l AS (SELECT c.*, u.last_user_question, a.last_answer, a.last_answer_place, substr(coalesce(nullif(trim(last_user_question), ''), '-'), 1, 80) AS title FROM c LEFT JOIN u USING (session_id) LEFT JOIN a USING (session_id))"""
SESSION_LIST = f"WITH {_SESSIONS} SELECT * FROM l"


def session_page(spark, sf_dir):
    listed = session_list(spark, sf_dir).select("session_id", "title", "message_count")
    return sessions.page(listed, 20, 10, F.col("message_count").desc(), F.col("session_id"))


SESSION_PAGE = f"""WITH {_SESSIONS}, p AS (SELECT session_id, title, message_count FROM l ORDER BY message_count DESC, session_id LIMIT 21 OFFSET 10),
n AS (SELECT *, row_number() OVER (ORDER BY message_count DESC, session_id) AS n, count(*) OVER () > 20 AS has_more FROM p)
SELECT session_id, title, message_count, has_more FROM n WHERE n <= 20"""


def turn_pairs(spark, sf_dir):
    return sessions.turns(messages(spark, sf_dir))


_TURNS = """
m AS (SELECT conv_id AS session_id, turn AS place, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')),
b AS (SELECT *, lag(role) OVER w AS before, lag(content) OVER w AS question, lag(place) OVER w AS question_place FROM m WINDOW w AS (PARTITION BY session_id ORDER BY place)),
t AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY place) AS INTEGER) AS turn, question_place, place, question, substr(content, 1, 240) AS answer_summary FROM b WHERE role = 'assistant' AND before = 'user')"""
TURN_PAIRS = f"WITH {_TURNS} SELECT * FROM t"


def last_n_turns(spark, sf_dir):
    return sessions.last_turns(messages(spark, sf_dir), 5)


LAST_TURNS = f"WITH {_TURNS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS INTEGER) AS back FROM t) SELECT * FROM r WHERE back <= 5"


def session_load(spark, sf_dir):
    s = sessions.loaded(messages(spark, sf_dir))
    return s.select("session_id", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("digest"))


SESSION_LOAD = """SELECT conv_id AS session_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END, role, text)) AS digest FROM conversations GROUP BY 1"""


def session_delete(spark, sf_dir):
    m = messages(spark, sf_dir)
    gone = m.where("session_id % 3 = 0").select("session_id").distinct()
    return sessions.deleted({"messages": m, "answers": m.where("role = 'assistant'")}, gone)[1]


SESSION_DELETE = """SELECT 'messages' AS table_name, count(*) AS n_deleted FROM conversations WHERE conv_id % 3 = 0
UNION ALL SELECT 'answers', count(*) FROM conversations WHERE conv_id % 3 = 0 AND role = 'assistant'"""


# ---- questions ----------------------------------------------------------------


def classify_questions(spark, sf_dir):
    m = messages(spark, sf_dir)
    kind = questions.query_type(F.col("content"))
    return m.where("role = 'user'").select("session_id", "place", kind.alias("query_type"), F.size(X.years(F.col("content"))).alias("n_years"))


def _contains(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_FLAT = r"lower(trim(replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t\f\x0B]+', ' ', 'g'), chr(10), ' ')))"
_TYPE = f"""CASE WHEN length(q) <= 4 THEN 'ambiguous_query' WHEN {_contains('q', questions.COMPARE)} THEN 'multi_doc_compare' WHEN {_contains('q', questions.REPORT)} THEN 'report_generation'
  WHEN {_contains('q', questions.CITATION)} THEN 'citation_locate' WHEN {_contains('q', questions.FACT)} THEN 'fact_lookup'
  WHEN ({_contains('q', questions.FINANCIAL)} OR {_contains('q', questions.TABLE)}) AND ({_contains('q', questions.VALUE)} OR regexp_matches(q, '(?:19|20)[0-9]{{2}}')) AND NOT ({_contains('q', questions.EXPLANATION)} AND NOT {_contains('q', ('多少', '分别'))}) THEN 'table_qa'
  WHEN {_contains('q', questions.SUMMARY)} THEN 'summarization' WHEN {_contains('q', questions.DEICTIC)} AND NOT regexp_matches(q, '(?:19|20)[0-9]{{2}}') THEN 'ambiguous_query' ELSE 'fact_lookup' END"""
CLASSIFY = f"""WITH m AS (SELECT conv_id AS session_id, turn AS place, text, {_FLAT} AS q FROM conversations WHERE role = 'user')
SELECT session_id, place, {_TYPE} AS query_type, CAST(len(regexp_extract_all(text, '(?:19|20)[0-9]{{2}}')) AS INTEGER) AS n_years FROM m"""


def extract_slots(spark, sf_dir):
    u = messages(spark, sf_dir).where("role = 'user'").withColumn("query_type", questions.query_type(F.col("content")))
    u = u.withColumn("s", questions.slots(F.col("content"), F.col("query_type")))
    return u.select("session_id", "place", F.array_join("s.years", ",").alias("years"), "s.metric", "s.period", F.size("s.compare_targets").alias("n_targets"), F.length("s.scope").alias("scope_length"), F.array_join(questions.missing_slots(F.col("query_type"), F.col("s")), ",").alias("missing"))


# ---- blocks and chunks ------------------------------------------------------------


def html_blocks(spark, sf_dir):
    return pages.html_blocks(table(spark, sf_dir, "pages"))


def block_counts(spark, sf_dir):
    b = html_blocks(spark, sf_dir)
    return b.groupBy("tag", "type").agg(F.count("*").alias("n_blocks"), F.count_distinct("page_id").alias("n_pages"))


def heading_paths(spark, sf_dir):
    b = html_blocks(spark, sf_dir).withColumnRenamed("page_id", "doc")
    h = chunking.with_headings(b, F.substring("tag", 2, 1).cast("int"))
    return h.select("doc", "place", "type", F.md5("heading_path").alias("heading"), F.col("level"))


def text_runs(spark, sf_dir):
    b = html_blocks(spark, sf_dir).withColumnRenamed("page_id", "doc")
    r = chunking.text_runs(chunking.with_headings(b, F.substring("tag", 2, 1).cast("int")))
    return r.select("doc", "run", "first_place", "n_blocks", F.length("text").alias("n_chars"))


def word_chunks(spark, sf_dir):
    c = chunking.word_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return c.select("doc_id", "chunk_index", "n_words", F.md5("content").alias("digest"))


WORD_CHUNKS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(0, greatest(0, CAST(ceil((len(words) - 200) / 160.0) AS INTEGER)) + 1)) AS chunk_index FROM w WHERE len(words) > 0),
c AS (SELECT doc_id, chunk_index, list_slice(words, chunk_index * 160 + 1, chunk_index * 160 + 200) AS part FROM i)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(len(part) AS INTEGER) AS n_words, md5(array_to_string(part, ' ')) AS digest FROM c"""


def budget_chunks(spark, sf_dir):
    c = chunking.budget_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", budget=128, overlap=20)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).alias("longest"))


# ---- stores -------------------------------------------------------------------------


def _versions(spark, sf_dir):
    """All documents as stored rows, and twice as incoming ones, of which the later version must win; every fifth source is all new."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    stored = d.select("doc_id", "source", F.col("n_chars").alias("version"), F.lit("old").alias("state"))
    incoming = d.select("doc_id", "source", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("version"), F.lit("first").alias("state")), F.struct((F.col("doc_id") % 3).alias("version"), F.lit("second").alias("state")))).alias("v")).select("doc_id", "source", "v.*")
    return stored, incoming.where("version <> 1 or state = 'first'")


def upsert_latest(spark, sf_dir):
    stored, incoming = _versions(spark, sf_dir)
    return store.upserted(stored, incoming, ["doc_id"], F.col("version"))


UPSERT = """SELECT doc_id, source, CAST(greatest(1, doc_id % 3) AS BIGINT) AS version, CASE WHEN doc_id % 3 = 2 THEN 'second' ELSE 'first' END AS state FROM documents"""


def replace_collection(spark, sf_dir):
    stored, _ = _versions(spark, sf_dir)
    # long documents come anew: their sources are replaced as a whole
    incoming = stored.where("version > 15000").withColumn("state", F.lit("new"))
    return store.replaced(stored, incoming, "source").groupBy("source", "state").agg(F.count("*").alias("n"))


REPLACE = """WITH s AS (SELECT DISTINCT source FROM documents WHERE n_chars > 15000)
SELECT source, 'old' AS state, count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM s) GROUP BY 1
UNION ALL SELECT source, 'new', count(*) FROM documents WHERE n_chars > 15000 GROUP BY 1"""


def delete_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    keys = d.where("lang = 'es'").groupBy("source").agg(F.count("*").alias("n")).where("n % 2 = 0").select("source")
    kept, gone = store.without(d, keys)
    return kept.groupBy("source").agg(F.count("*").alias("n_kept")).join(gone, "source", "full_outer")


DELETE = """WITH k AS (SELECT source FROM documents WHERE lang = 'es' GROUP BY source HAVING count(*) % 2 = 0)
SELECT source, CASE WHEN source NOT IN (SELECT source FROM k) THEN count(*) END AS n_kept, CASE WHEN source IN (SELECT source FROM k) THEN count(*) END AS n_deleted FROM documents GROUP BY source"""


def incremental_skip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    incoming = d.select("doc_id", F.col("source").alias("collection_name"), F.col("doc_id").cast("string").alias("doc_source"), F.sha2("text", 256).alias("doc_hash"))
    stored = d.where("doc_id % 4 <> 0").select(F.col("source").alias("collection_name"), F.col("doc_id").cast("string").alias("doc_source"), F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.sha2("text", 256)).alias("doc_hash"), "doc_id", F.lit(0).alias("indexed_at"))
    return store.plan(incoming, stored).select("doc_id", "collection_name", "doc_hash", "action")


SKIP = """SELECT doc_id, source AS collection_name, sha256(text) AS doc_hash, CASE WHEN doc_id % 4 = 0 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'replace' ELSE 'skip' END AS action FROM documents"""


def document_pages(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("collection_name"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("page_count"), (F.col("doc_id") * 2).alias("page_idx"))
    old = c.select("doc_id").distinct().withColumn("page_count", F.lit(1500))
    return store.documents_of(c, old).select("doc_id", F.col("page_count").cast("long").alias("page_count"))


PAGES = """SELECT source AS doc_id, greatest(max(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id * 2 + 1 END), 1500) AS page_count FROM documents GROUP BY source"""


# ---- events and the star schema (what Spark adds) -------------------------------------


def latency_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("longest"), F.round(F.avg("value"), 6).alias("mean"))


PROFILE = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS longest, round(avg(value), 6) AS mean FROM events GROUP BY event_type"


def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"))


WINDOWS = """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""


def event_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


JSON = "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1"


def star_revenue(spark, sf_dir):
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = rows.rollup("r_name", "n_name").agg(F.count("*").alias("n_items"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.select("r_name", "n_name", "n_items", F.round("revenue", 0).alias("revenue"))


STAR = """SELECT r_name, n_name, count(*) AS n_items, round(round(sum(l_extendedprice * (1 - l_discount)), 2), 0) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""


def best_customers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("spent").desc(), "c_custkey")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 5").select("c_mktsegment", "c_custkey", "spent", "place")


BEST = """WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1),
r AS (SELECT c_mktsegment, c_custkey, spent, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY spent DESC, c_custkey) AS INTEGER) AS place FROM customer JOIN s ON c_custkey = o_custkey)
SELECT * FROM r WHERE place <= 5"""

QUERIES = {
    "session_list": (session_list, SESSION_LIST),
    "session_page": (session_page, SESSION_PAGE),
    "turn_pairs": (turn_pairs, TURN_PAIRS),
    "last_n_turns": (last_n_turns, LAST_TURNS),
    "session_load": (session_load, SESSION_LOAD),
    "session_delete": (session_delete, SESSION_DELETE),
    "classify_questions": (classify_questions, CLASSIFY),
    "extract_slots": (extract_slots, None),
    "html_blocks": (html_blocks, None),
    "block_counts": (block_counts, None),
    "heading_path": (heading_paths, None),
    "text_runs": (text_runs, None),
    "word_chunks": (word_chunks, WORD_CHUNKS),
    "budget_chunks": (budget_chunks, None),
    "upsert_latest": (upsert_latest, UPSERT),
    "replace_collection": (replace_collection, REPLACE),
    "delete_source": (delete_source, DELETE),
    "incremental_skip": (incremental_skip, SKIP),
    "doc_maxpage": (document_pages, PAGES),
    "latency_profile": (latency_profile, PROFILE),
    "event_windows": (event_windows, WINDOWS),
    "event_json": (event_json, JSON),
    "star_revenue": (star_revenue, STAR),
    "best_customers": (best_customers, BEST),
}
