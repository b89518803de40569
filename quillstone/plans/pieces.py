"""Queries of the smaller operators: candidates, sessions' records, question rules, content and blocks of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers, candidates, chunking, questions, retrieval, sessions, store
from ..operators.evidence import citations
from .records import _TURNS, _contains, messages
from .search import _EVIDENCE_SQL, SQL_TOK, TOKENS, _bm25_sql, _evidence, asked, bm25_topk, corpus
from .tables import table


def _hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang", "n_chars")
    return bm25_topk(spark, sf_dir).join(d, "chunk_id")


_HITS = f"""{_bm25_sql()},
h AS (SELECT hits.*, source, lang, n_chars FROM hits JOIN documents d ON d.doc_id = chunk_id)"""


# ---- candidates -----------------------------------------------------------------


def score_accessor(spark, sf_dir):
    rows = _hits(spark, sf_dir).select("qid", "chunk_id", F.when(F.col("lang") == "de", F.col("bm25_raw") / 10).alias("confidence_score"), F.when(F.col("lang") == "en", F.col("bm25_score") / 2).alias("final_score"), "bm25_score")
    gate, source = candidates.score_of(rows)
    answer, _ = candidates.score_of(rows, candidates.ANSWER_SCORES)
    return rows.select("qid", "chunk_id", F.round(gate, 6).alias("gate_score"), source.alias("gate_source"), F.round(answer, 6).alias("answer_score"), F.round(candidates.recall_score(rows), 6).alias("recall_score"))


SCORE_ACCESSOR = f"""WITH {_HITS},
s AS (SELECT qid, chunk_id, CASE WHEN lang = 'de' THEN least(1.0, greatest(0.0, bm25_raw / 10)) END AS c, CASE WHEN lang = 'en' THEN bm25_score / 2 END AS f, bm25_score AS b FROM h)
SELECT qid, chunk_id, round(coalesce(c, f, b), 6) AS gate_score, CASE WHEN c IS NOT NULL THEN 'confidence_score' WHEN f IS NOT NULL THEN 'final_score' ELSE 'bm25_score' END AS gate_source,
  round(coalesce(c, f, 0.0), 6) AS answer_score, round(b, 6) AS recall_score FROM s"""


def fallback_select(spark, sf_dir):
    rows = candidates.fallback(_hits(spark, sf_dir).withColumn("query_type", F.when(F.col("qid") % 2 == 0, "table_qa").otherwise("fact_lookup")).withColumn("chunk_type", F.when(F.col("lang") == "de", "table").otherwise("text")))
    return retrieval.with_adaptive_quota(rows, 5).select("qid", "chunk_id", F.round("rank_score", 6).alias("rank_score"), "score_source", "place")


FALLBACK = f"""WITH {_HITS},
t AS (SELECT qid, chunk_id, bm25_score AS s, qid % 2 = 0 AND lang = 'de' AND bm25_score >= greatest(0.25, 0.45 * max(bm25_score) OVER (PARTITION BY qid)) AS fit FROM h),
f AS (SELECT *, fit AND row_number() OVER (PARTITION BY qid, fit ORDER BY s DESC, chunk_id) <= 2 AS first FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first DESC, s DESC, chunk_id) AS place FROM f)
SELECT qid, chunk_id, round(s, 6) AS rank_score, 'hybrid_recall_score' AS score_source, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5"""


def intent_weights(spark, sf_dir):
    rows = _hits(spark, sf_dir).withColumn("query_type", F.when(F.col("qid") % 2 == 0, "table_qa").otherwise("fact_lookup")).withColumn("dense_score", F.col("bm25_score") * F.col("bm25_score"))
    out = retrieval.fused_by_intent(rows, (F.col("source") == "src1").cast("double"), (F.col("lang") == "de").cast("double"))
    return out.select("qid", "chunk_id", F.round("final_score", 5).alias("final_score"))


WEIGHTS = f"""WITH {_HITS}, s AS (SELECT qid, chunk_id, bm25_score AS b, CAST(source = 'src1' AS INTEGER) AS f, CAST(lang = 'de' AS INTEGER) AS t FROM h)
SELECT qid, chunk_id, round(round(CASE WHEN qid % 2 = 0 THEN 0.40 * b * b + 0.35 * b + 0.15 * f + 0.10 * t ELSE 0.55 * b * b + 0.25 * b + 0.15 * f + 0.05 * t END, 7), 5) AS final_score FROM s"""


def merged_pools(spark, sf_dir):
    h = _hits(spark, sf_dir)
    return candidates.merged_pools(6, h.where("lang = 'fr'").select("qid", "chunk_id", "rank"), h.select("qid", "chunk_id", "rank"))


POOLS = f"""WITH {_HITS}, p AS (SELECT qid, chunk_id, rank, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS pool FROM h),
n AS (SELECT qid, chunk_id, CAST(pool AS INTEGER) AS pool, CAST(row_number() OVER (PARTITION BY qid ORDER BY pool, rank, chunk_id) AS INTEGER) AS place FROM p)
SELECT * FROM n WHERE place <= 6"""


def coerced_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.length("text") > 500, F.col("doc_id")).alias("id"), "text", F.col("source").alias("doc_source"), F.nullif("lang", F.lit("de")).alias("chunk_type"))
    c = candidates.coerced(d)
    return c.select("chunk_id", "doc_source", "chunk_type", F.md5("content").alias("digest"), F.size(F.array(*[F.col(x).isNull() for x in c.columns])).alias("n_fields"))


COERCED = """SELECT CASE WHEN length(text) > 500 THEN CAST(doc_id AS VARCHAR) ELSE 'hash_' || substr(sha1(text), 1, 16) END AS chunk_id, source AS doc_source, CASE WHEN lang = 'de' THEN 'text' ELSE lang END AS chunk_type, md5(text) AS digest, 15 AS n_fields FROM documents"""


def max_share(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return candidates.share_of_most(e, "value", "event_type").select("event_id", F.round("value_share", 6).alias("value_share"))


SHARE = "SELECT event_id, round(CASE WHEN max(value) OVER (PARTITION BY event_type) > 0 THEN value / max(value) OVER (PARTITION BY event_type) ELSE 0.0 END, 6) AS value_share FROM events"


def stage_residual(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("request_id"), F.when(F.col("event_type") == "purchase", "total").otherwise(F.col("event_type")).alias("stage"), F.round("value", 4).alias("ms"))
    return candidates.residual(rows)


RESIDUAL = """WITH r AS (SELECT user_id, sum(CASE WHEN event_type <> 'purchase' THEN round(value, 4) ELSE 0.0 END) AS timed, max(CASE WHEN event_type = 'purchase' THEN round(value, 4) END) AS total FROM events GROUP BY 1)
SELECT user_id AS request_id, round(timed, 4) AS timed, round(greatest(0.0, coalesce(total, timed) - timed), 4) AS residual FROM r"""


def response_rows(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("doc_source", F.concat(F.lit("/data/"), "doc_id", F.lit(".pdf")))
    return candidates.response(e).select("qid", "chunk_id", "doc_source", "citation", F.round("score", 6).alias("score"), F.md5("content").alias("digest"))


RESPONSE = f"WITH {_EVIDENCE_SQL} SELECT qid, chunk_id, doc_id || '.pdf' AS doc_source, 'C' || rank AS citation, round(score, 6) AS score, md5(content) AS digest FROM e"


def citation_zip(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return candidates.zipped(e.select("qid", "rank", "chunk_id"), citations(e).where("rank <= 3").select("qid", "rank", "citation_id"))


ZIP = f"""WITH {_EVIDENCE_SQL}, n AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM e)
SELECT e.qid, e.rank, e.chunk_id, CASE WHEN n.rank <= 3 THEN 'C' || n.rank END AS citation_citation_id FROM e LEFT JOIN n ON n.qid = e.qid AND n.rank = e.rank"""


def latest_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection_name"), F.col("lang").alias("doc_source"), F.col("n_chars").alias("indexed_at"))
    return store.latest_documents(d)


LATEST = """SELECT doc_id, source AS collection_name, lang AS doc_source, n_chars AS indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1"""


# ---- dense search without vectors, keyword search with a bound ---------------------------


def hash_embedding_topk(spark, sf_dir):
    return retrieval.hash_dense(corpus(spark, sf_dir), asked(spark, sf_dir), 5)


def _cells(name: str, source: str, key: str) -> str:
    return rf"""{name}_n AS (SELECT {key} AS id, term, count(*) AS n FROM (SELECT {key}, unnest({SQL_TOK}) AS term FROM {source}) GROUP BY 1, 2),
{name}_c AS (SELECT id, tail % 1024 AS bucket, sum(CASE WHEN (tail & 256) = 0 THEN n ELSE -n END) AS v FROM (SELECT id, n, CAST('0x' || substr(sha256(term), 62, 3) AS INTEGER) AS tail FROM {name}_n) GROUP BY 1, 2),
{name} AS (SELECT id, bucket, v / sqrt(sum(CAST(v * v AS DOUBLE)) OVER (PARTITION BY id)) AS w FROM {name}_c WHERE v <> 0)"""


HASH_TOPK = f"""WITH {_cells('d', 'documents', 'doc_id')}, {_cells('q', 'benchmark', 'item_id')},
s AS (SELECT q.id AS qid, d.id AS chunk_id, round(least(1.0, greatest(0.0, sum(d.w * q.w))), 6) AS dense_score FROM d JOIN q USING (bucket) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE dense_score > 0)
SELECT * FROM r WHERE rank <= 5"""


def keyword_min_score(spark, sf_dir):
    return retrieval.overlap(corpus(spark, sf_dir), asked(spark, sf_dir), 10, 0.4)


KEYWORD_MIN = rf"""WITH q AS (SELECT item_id AS qid, list_distinct({SQL_TOK}) AS t FROM benchmark), d AS (SELECT doc_id AS chunk_id, list_distinct({SQL_TOK}) AS t FROM documents),
x AS (SELECT qid, chunk_id, len(list_intersect(q.t, d.t)) AS h, len(q.t) AS a, len(d.t) AS b FROM q, d),
s AS (SELECT qid, chunk_id, round(least(1.0, 0.7 * h / greatest(a, 1) + 0.3 * h / greatest(b, 1)), 8) AS score FROM x WHERE h > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE score >= 0.4)
SELECT * FROM r WHERE rank <= 10"""


# ---- sessions ---------------------------------------------------------------------


def message_listing(spark, sf_dir):
    return sessions.listed(messages(spark, sf_dir), {"role": "assistant", "session_id": None}, F.col("place").desc(), F.col("session_id"), F.col("content"), limit=50)


LISTING = "SELECT conv_id AS session_id, turn AS place, role, text AS content FROM conversations WHERE role = 'assistant' ORDER BY turn DESC, conv_id, text LIMIT 50"


def latest_assistant(spark, sf_dir):
    return sessions.latest(messages(spark, sf_dir), "assistant").select("session_id", "place")


LATEST_ASSISTANT = "SELECT conv_id AS session_id, max(turn) AS place FROM conversations WHERE role = 'assistant' GROUP BY 1"


def save_turn(spark, sf_dir):
    """Every turn saved, a third of them twice: the rows and sessions of each table."""
    t = sessions.turns(messages(spark, sf_dir))
    t = t.select("session_id", F.lit("c").alias("collection_name"), F.col("turn").cast("long").alias("place"), "question", F.col("answer_summary").alias("answer"), F.lit("answer").alias("decision"), F.lit("fact_lookup").alias("query_type"), F.lit(0.5).alias("confidence"), F.lit("{}").alias("trace"), F.lit("{}").alias("metrics"), F.col("turn").cast("long").alias("created_at"))
    empty = {
        "messages": "message_id string, session_id long, created_at long, place long, role string, content string, decision string, confidence double",
        "traces": "trace_id string, message_id string, session_id long, created_at long, question string, trace string",
        "evaluations": "evaluation_id string, message_id string, session_id long, created_at long, metrics string",
        "sessions": "session_id long, collection_name string, updated_at long",
    }
    tables = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    tables = sessions.saved_turn(tables, t)
    # a turn that is saved again is there once
    tables = sessions.saved_turn(tables, t.where("place % 3 = 0"))
    out = None
    for k in ("messages", "traces", "evaluations", "sessions"):
        n = tables[k].agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions")).select(F.lit(k).alias("table_name"), "n", "n_sessions")
        out = n if out is None else out.unionByName(n)
    return out


SAVE_TURN = f"""WITH {_TURNS}, n AS (SELECT count(*) AS n, count(DISTINCT session_id) AS s FROM t)
SELECT 'messages' AS table_name, 2 * n AS n, s AS n_sessions FROM n UNION ALL SELECT 'traces', n, s FROM n UNION ALL SELECT 'evaluations', n, s FROM n UNION ALL SELECT 'sessions', s, s FROM n"""


def _focus(spark, sf_dir):
    t = sessions.turns(messages(spark, sf_dir))
    slots = F.struct(F.lit("").alias("company"), F.regexp_extract("question", "(?:19|20)[0-9]{2}", 0).alias("period"), F.lit(" ").alias("metric"), F.lit(None).cast("string").alias("scope"))
    t = t.select("session_id", "turn", F.when(F.length("answer_summary") % 3 == 0, "pending").otherwise("completed").alias("status"), F.nullif(F.trim("question"), F.lit("")).alias("effective_question"), "question", questions.query_type(F.col("question")).alias("query_type"), slots.alias("slots"))
    return sessions.last_focus(t)


def last_focus(spark, sf_dir):
    return _focus(spark, sf_dir).select("session_id", "active_topic", "period", "metric", "updated_at_turn")


_FOCUS = f"""{_TURNS},
f AS (SELECT session_id, arg_max(coalesce(nullif(trim(question), ''), question), turn) AS active_topic, arg_max(coalesce(regexp_extract(question, '(?:19|20)[0-9]{{2}}'), ''), turn) AS period, max(turn) AS updated_at_turn FROM t WHERE length(answer_summary) % 3 <> 0 GROUP BY 1)"""
FOCUS = f"WITH {_FOCUS} SELECT session_id, active_topic, nullif(trim(period), '') AS period, CAST(NULL AS VARCHAR) AS metric, updated_at_turn FROM f"


def turn_routing(spark, sf_dir):
    """The last question of each session as a follow-up, whose confidence depends on its length."""
    m = messages(spark, sf_dir)
    last = sessions.latest(m, "user").select("session_id", F.col("content").alias("question"), (F.length("content") % 10 / 10).alias("confidence"), F.lit("follow_up").alias("proposed"))
    pending = sessions.latest(m, "system").select("session_id", F.col("content").alias("original_question"))
    out = sessions.routed(last, _focus(spark, sf_dir), pending)
    return out.select("session_id", "turn_type", F.md5("effective_question").alias("effective_question"))


ROUTING = f"""WITH {_FOCUS},
u AS (SELECT conv_id AS session_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1),
s AS (SELECT conv_id AS session_id, arg_max(text, turn) AS asked FROM conversations WHERE role = 'system' GROUP BY 1),
r AS (SELECT u.*, active_topic, asked, CASE WHEN asked IS NOT NULL THEN 'clarification_answer' WHEN length(question) % 10 / 10.0 >= 0.55 AND active_topic IS NOT NULL THEN 'follow_up' ELSE 'new_question' END AS turn_type FROM u LEFT JOIN f USING (session_id) LEFT JOIN s USING (session_id))
SELECT session_id, turn_type, md5(CASE turn_type WHEN 'clarification_answer' THEN asked || ' ' || question WHEN 'follow_up' THEN active_topic || ' ' || question ELSE question END) AS effective_question FROM r"""


# ---- questions and contents ---------------------------------------------------------------


def keyword_types(spark, sf_dir):
    u = messages(spark, sf_dir).where("role = 'user'")
    return u.select("session_id", "place", questions.keyword_type(F.col("content")).alias("query_type"), X.asks_for_table(F.col("content")).alias("asks_for_table"))


KEYWORD_TYPES = rf"""WITH m AS (SELECT conv_id AS session_id, turn AS place, lower(trim(text)) AS q, lower(text) AS low FROM conversations WHERE role = 'user')
SELECT session_id, place, CASE WHEN q = '' THEN 'ambiguous_query' WHEN {_contains('q', questions.COMPARE)} THEN 'multi_doc_compare' WHEN {_contains('q', questions.REPORT)} THEN 'report_generation' WHEN {_contains('q', questions.CITATION)} THEN 'citation_locate'
  WHEN ({_contains('q', questions.FINANCIAL)} OR {_contains('q', questions.TABLE)}) AND ({_contains('q', questions.VALUE)} OR regexp_matches(q, '(?:19|20)[0-9]{{2}}')) AND NOT ({_contains('q', questions.EXPLANATION)} AND NOT {_contains('q', ('多少', '分别'))}) THEN 'table_qa'
  WHEN {_contains('q', (*questions.FACT, 'fact', 'lookup', 'definition', 'clause'))} THEN 'fact_lookup' WHEN {_contains('q', questions.TABLE)} THEN 'table_qa' WHEN {_contains('q', questions.SUMMARY)} THEN 'summarization' WHEN {_contains('q', ('ambiguous', 'missing context', 'unclear'))} THEN 'ambiguous_query' END AS query_type,
  {_contains('low', X.TABLE_HINTS)} OR (len({TOKENS.format(c='low')}) >= 4 AND regexp_matches(low, '[0-9]')) AS asks_for_table FROM m"""


def default_variants(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(X.default_variants(F.col("question"), 3), " | ").alias("variants"))


DEFAULT_VARIANTS = rf"""WITH t AS (SELECT item_id AS qid, trim(text) AS text, {SQL_TOK} AS tokens FROM benchmark),
v AS (SELECT qid, text, list_distinct([array_to_string(tokens, ' '), array_to_string(tokens[1:6], ' ')]) AS found, array_to_string(tokens, ' ') AS whole, array_to_string(tokens[1:6], ' ') AS six, len(tokens) AS n FROM t)
SELECT qid, array_to_string(list_filter([CASE WHEN whole <> text AND whole <> '' THEN whole END, CASE WHEN n >= 2 AND six <> whole AND six <> text THEN six END], lambda x: x IS NOT NULL), ' | ') AS variants FROM v"""


def normalized_content(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lang = F.concat(F.lit('[{"text":" '), "event_type", F.lit('  x"},"'), "user_id", F.lit('"]'))
    return e.select("event_id", X.normalize_content(F.col("props")).alias("object"), X.normalize_content(lang).alias("list"), X.normalize_content(F.col("event_type")).alias("plain"))


CONTENT = r"""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS object, event_type || ' x' || chr(10) || user_id AS list, event_type AS plain FROM events"""


def listed_queries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fenced = F.concat(F.lit('so: ```json\n{"queries":'), F.to_json(F.array("source", "lang", "source")), F.lit("}\n```"))
    bullets = F.concat(F.lit("these:\n- "), "lang", F.lit("\n2. "), "source")
    return d.select("doc_id", F.array_join(X.json_queries(fenced), ",").alias("fenced"), F.array_join(X.json_queries(bullets), ",").alias("bullets"))


LISTED = "SELECT doc_id, source || ',' || lang AS fenced, lang || ',' || source AS bullets FROM documents"


def canonical_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.canonical_hash(F.struct("source", "doc_id", "lang"), 16).alias("hash"))


HASHES = """SELECT doc_id, substr(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}'), 1, 16) AS hash FROM documents"""


def refusal_texts(spark, sf_dir):
    """A text for each question, by reasons that depend on its length."""
    reasons = [*answers.REFUSALS, *(f"{r}_after_retry" for r in answers.REFUSALS), "low_score", ""]
    reason = F.get(F.array(*[F.lit(r) for r in reasons]), (F.length("question") % len(reasons)).cast("int"))
    kind = F.when(F.col("qid") % 2 == 0, "citation_locate").otherwise("fact_lookup")
    return asked(spark, sf_dir).select("qid", answers.refusal(kind, reason).alias("refusal"), answers.clarification(reason).alias("clarification"))


def _refusals() -> str:
    reasons = [*answers.REFUSALS, *(f"{r}_after_retry" for r in answers.REFUSALS), "low_score", ""]
    cases = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(reasons))
    texts = " ".join(f"WHEN '{r}' THEN '{t}' WHEN '{r}_after_retry' THEN '{t}'" for r, t in answers.REFUSALS.items())
    return f"""WITH r AS (SELECT item_id AS qid, CASE length(text) % {len(reasons)} {cases} END AS reason FROM benchmark)
SELECT qid, CASE reason {texts} ELSE CASE WHEN qid % 2 = 0 THEN '{answers.REFUSED_CITATION}' ELSE '{answers.REFUSED}' END END AS refusal, '{answers.CLARIFY}' || coalesce(nullif(reason, ''), 'missing_slots') AS clarification FROM r"""


# ---- blocks ------------------------------------------------------------------------


def _blocks(spark, sf_dir):
    """Conversations as documents: questions are titles of levels 1 to 3, answers text, other messages tables."""
    m = messages(spark, sf_dir)
    kind = F.when(F.col("role") == "user", "title").when(F.col("role") == "assistant", "text").otherwise("table")
    return m.select(F.col("session_id").alias("doc"), "place", kind.alias("type"), F.col("content").alias("text"), (F.col("place") % 7 - 1).cast("int").alias("page_idx"), (1 + F.col("place") % 3).cast("int").alias("own_level"))


def turn_headings(spark, sf_dir):
    h = chunking.with_headings(_blocks(spark, sf_dir), F.col("own_level"))
    return h.select("doc", "place", "type", "level", F.md5("heading_path").alias("heading"))


_HEADINGS = rf"""
b AS (SELECT conv_id AS doc, turn AS place, CASE role WHEN 'user' THEN 'title' WHEN 'assistant' THEN 'text' ELSE 'table' END AS type, text, CASE WHEN role = 'user' THEN CAST(1 + turn % 3 AS INTEGER) ELSE 0 END AS level,
  trim(replace(regexp_replace(text, '[ \t\f\x0B]+', ' ', 'g'), chr(10), ' ')) AS flat FROM conversations),
l AS (SELECT *, max(CASE WHEN level = 1 THEN place END) OVER w AS p1, max(CASE WHEN level = 2 THEN place END) OVER w AS p2, max(CASE WHEN level = 3 THEN place END) OVER w AS p3,
  arg_max(CASE WHEN level = 1 THEN flat END, CASE WHEN level = 1 THEN place END) OVER w AS t1, arg_max(CASE WHEN level = 2 THEN flat END, CASE WHEN level = 2 THEN place END) OVER w AS t2, arg_max(CASE WHEN level = 3 THEN flat END, CASE WHEN level = 3 THEN place END) OVER w AS t3
  FROM b WINDOW w AS (PARTITION BY doc ORDER BY place)),
h AS (SELECT *, coalesce(nullif(array_to_string(list_filter([t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > coalesce(p1, -1) AND p3 > coalesce(p2, -1) THEN t3 END], lambda x: x IS NOT NULL AND x <> ''), ' > '), ''), 'front_matter') AS path FROM l)"""
TURN_HEADINGS = f"WITH {_HEADINGS} SELECT doc, place, type, level, md5(path) AS heading FROM h"


def turn_runs(spark, sf_dir):
    r = chunking.text_runs(chunking.with_headings(_blocks(spark, sf_dir), F.col("own_level")))
    return r.select("doc", "run", "first_place", "n_blocks", F.md5("text").alias("digest"))


TURN_RUNS = f"""WITH {_HEADINGS}, r AS (SELECT *, sum(CASE WHEN type <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY place) AS run FROM h)
SELECT doc, CAST(run AS BIGINT) AS run, min(place) AS first_place, count(*) AS n_blocks, md5(string_agg(text, chr(10) ORDER BY place, text)) AS digest FROM r WHERE type = 'text' AND trim(text) <> '' GROUP BY doc, run, path"""


def table_contexts(spark, sf_dir):
    return chunking.table_contexts(_blocks(spark, sf_dir)).select("doc", "place", F.md5("table_context_text").alias("context"))


CONTEXTS = """WITH b AS (SELECT conv_id AS doc, turn AS place, role, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)
SELECT doc, place, md5(substr(coalesce(before, ''), 1, 800)) AS context FROM b WHERE role NOT IN ('user', 'assistant')"""


def page_ranges(spark, sf_dir):
    b = _blocks(spark, sf_dir).groupBy("doc", "type").agg(F.collect_list("page_idx").alias("pages"), F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_blocks"))
    return b.select("doc", "type", "n_blocks", "n_chars", chunking.page_range(F.col("pages")).alias("p")).select("doc", "type", "n_blocks", "n_chars", "p.*")


RANGES = """WITH b AS (SELECT conv_id AS doc, CASE role WHEN 'user' THEN 'title' WHEN 'assistant' THEN 'text' ELSE 'table' END AS type, text, turn % 7 - 1 AS page FROM conversations)
SELECT doc, type, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(coalesce(min(CASE WHEN page >= 0 THEN page END), -1) AS INTEGER) AS first, CAST(coalesce(max(CASE WHEN page >= 0 THEN page END), -1) AS INTEGER) AS last FROM b GROUP BY 1, 2"""


def structured_chunks(spark, sf_dir):
    """Whole conversations through the chunker; other messages are one-row tables under a header."""
    b = _blocks(spark, sf_dir).withColumn("rows", F.when(F.col("type") == "table", F.array(F.array(F.lit("role"), F.lit("text")), F.array(F.lit("other"), F.col("text"))))).withColumn("table_id", F.when(F.col("type") == "table", F.concat(F.lit("table_"), "place")))
    c = chunking.structured_chunks(b, 64, 12, 256)
    return c.select("doc", "chunk_index", "chunk_id", "chunk_type", "page_range", F.md5("content").alias("digest"), F.length("table_context_text").alias("context_chars"))


def recursive_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", chunking.recursive_parts(F.col("text"), 256, 32).alias("parts"))
    return d.select("doc_id", F.size("parts").alias("n_parts"), F.coalesce(F.array_max(F.transform("parts", X.token_count)), F.lit(0)).alias("most_tokens"))


QUERIES = {
    "score_accessor": (score_accessor, SCORE_ACCESSOR),
    "fallback_select": (fallback_select, FALLBACK),
    "intent_weights": (intent_weights, WEIGHTS),
    "merged_pools": (merged_pools, POOLS),
    "coerced_rows": (coerced_rows, COERCED),
    "max_share": (max_share, SHARE),
    "stage_residual": (stage_residual, RESIDUAL),
    "response_rows": (response_rows, RESPONSE),
    "citation_zip": (citation_zip, ZIP),
    "latest_documents": (latest_documents, LATEST),
    "hash_embedding_topk": (hash_embedding_topk, HASH_TOPK),
    "keyword_min_score": (keyword_min_score, KEYWORD_MIN),
    "message_listing": (message_listing, LISTING),
    "latest_assistant": (latest_assistant, LATEST_ASSISTANT),
    "save_turn": (save_turn, SAVE_TURN),
    "last_focus": (last_focus, FOCUS),
    "turn_routing": (turn_routing, ROUTING),
    "keyword_types": (keyword_types, KEYWORD_TYPES),
    "default_variants": (default_variants, DEFAULT_VARIANTS),
    "normalized_content": (normalized_content, CONTENT),
    "listed_queries": (listed_queries, LISTED),
    "canonical_hashes": (canonical_hashes, HASHES),
    "refusal_texts": (refusal_texts, _refusals()),
    "turn_headings": (turn_headings, TURN_HEADINGS),
    "turn_runs": (turn_runs, TURN_RUNS),
    "table_contexts": (table_contexts, CONTEXTS),
    "page_ranges": (page_ranges, RANGES),
    "structured_chunks": (structured_chunks, None),
    "recursive_split": (recursive_split, None),
}
