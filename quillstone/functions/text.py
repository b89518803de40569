"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK runs or ASCII words; everything else separates.
COARSE = "[\\u4e00-\\u9fff]+|[a-z0-9_]+"


def _capital(c: str) -> str:
    """The one capital letter of a letter; the letter itself where only several would do."""
    return next((x for x in (c.upper(), c.title(), "\u1e9e" if c == "\u00df" else c) if len(x) == 1), c)


@cache
def _case_pairs() -> tuple[str, str]:
    """Letters, and their capitals one for one."""
    small = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if _capital(c) != c)
    return small, "".join(map(_capital, small))


def upper_each(c: Column) -> Column:
    """Capitals letter by letter, as SQL engines other than the JVM have them: no letter becomes two."""
    return F.translate(c, *_case_pairs())


def clean(c: Column) -> Column:
    """Null for null, empty and blank texts: `missing` is usually an empty string in the data."""
    return F.nullif(F.trim(c), F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[clean(c) for c in columns], F.lit(""))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def normalize_whitespace(c: Column, preserve_newlines: bool = True) -> Column:
    """One space for runs of blanks; lines are stripped and blank ones dropped, or joined by spaces."""
    c = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n"), "\u00a0\u3000", "  ")
    if not preserve_newlines:
        return strip(F.translate(F.regexp_replace(c, "[ \\t\\f\\x0B]+", " "), "\n", " "))
    lines = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, "[ \\t\\f\\x0B]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def grams(run: Column, n: int) -> Column:
    """All n-character pieces of a text."""
    places = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(run, i, F.lit(n)))


def coarse_tokens(c: Column) -> Column:
    """Lower-case ASCII words, and CJK runs followed by their 2- and 3-character pieces (short runs come twice)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(COARSE), F.lit(0))
    pieces = F.transform(found, lambda t: F.when(t >= "\u4e00", F.concat(F.array(t), grams(t, 2), grams(t, 3))).otherwise(F.array(t)))
    # most texts hold no CJK: only others are taken apart further
    return F.when((F.length(c) < F.octet_length(c)) & F.rlike(c, F.lit("[\\u4e00-\\u9fff]")), F.flatten(pieces)).otherwise(found)


def long_gram_tokens(c: Column) -> Column:
    """The secondary ranker's tokens: CJK runs of over three characters as 2- to 4-character pieces and the run."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(COARSE), F.lit(0))
    whole = lambda t: (t < "\u4e00") | (F.length(t) <= 3)
    pieces = F.transform(found, lambda t: F.when(whole(t), F.array(t)).otherwise(F.concat(grams(t, 2), grams(t, 3), grams(t, 4), F.array(t))))
    return F.flatten(pieces)


def char_tokens(c: Column) -> Column:
    """Words or single CJK characters; a text without any gives its characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.regexp_extract_all(low, F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.split(low, ""), lambda x: x != ""))


def word_set(c: Column) -> Column:
    """Distinct words by Unicode letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}_]+"), lambda x: x != ""))


def exact_key(c: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}_]+", "")


def overlap_score(hits: Column, query_size: Column, text_size: Column) -> Column:
    score = 0.7 * hits / F.greatest(query_size, F.lit(1)) + 0.3 * hits / F.greatest(text_size, F.lit(1))
    return F.when(hits > 0, clip01(score)).otherwise(F.lit(0.0))


def token_overlap(query: Column, text: Column) -> Column:
    """overlap_score of two token arrays as sets."""
    a, b = F.array_distinct(query), F.array_distinct(text)
    return overlap_score(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def near_duplicate_score(a: Column, b: Column) -> Column:
    """The larger of Jaccard similarity and containment in the smaller set."""
    both = F.size(F.array_intersect(a, b))
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.greatest(both / small, both / F.size(F.array_union(a, b)))).otherwise(F.lit(0.0))


def page_hint(c: Column) -> Column:
    """The number after `page`, `p` or the CJK ordinal mark, or null."""
    found = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), "(?:page|p|\u7b2c)\\s*([0-9]{1,4})", 1)
    return F.nullif(found, F.lit("")).cast("int")


def years(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?:19|20)[0-9]{2}"), F.lit(0))


def numbers(c: Column) -> Column:
    """Numbers with thousands separators, decimals and a percent sign."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("-?[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?%?"), F.lit(0))


def quoted(c: Column) -> Column:
    """Texts between quotation marks or title marks, stripped; blank ones are left out."""
    marks = "\"'\u201c\u201d\u2018\u2019"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[{marks}\u300a](.+?)[{marks}\u300b]"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def token_count(c: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def short_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """A prefix and the first hex digits of the SHA-1 of the parts joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, length))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.coalesce(c, F.lit("")), "[/\\\\]"), -1)


def coverage(value: Column, corpus: Column) -> Column:
    """The value is in the corpus, or at least half of its tokens are."""
    v, text = F.lower(strip(value)), F.lower(corpus)
    parts = F.regexp_extract_all(v, F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]"), F.lit(0))
    hits = F.size(F.filter(parts, lambda t: F.contains(text, t)))
    return (v != "") & (F.contains(text, v) | ((F.size(parts) > 0) & (hits >= 0.5 * F.size(parts))))


#: Politeness and question phrases that a concise rewrite leaves out (fixed values).
PHRASES = ("\u8bf7\u95ee", "\u9ebb\u70e6", "\u5e2e\u6211", "\u5e2e\u5fd9", "\u80fd\u4e0d\u80fd", "\u662f\u5426\u53ef\u4ee5", "\u53ef\u4ee5\u5417", "\u8fd9\u4e2a\u6587\u6863(\u91cc|\u4e2d)?", "\u8be5\u6587\u6863(\u91cc|\u4e2d)?", "\u6839\u636e(\u6587\u6863|\u6750\u6599|\u8d44\u6599)", "\u8bf7(\u7ed9\u51fa|\u8bf4\u660e|\u67e5\u8be2|\u67e5\u627e|\u56de\u7b54)", "\u662f\u4ec0\u4e48", "\u662f\u591a\u5c11", "\u6709\u54ea\u4e9b", "\u5982\u4f55")
#: Tokens that a compact rewrite leaves out (fixed values).
STOP_WORDS = ("\u4ec0\u4e48", "\u591a\u5c11", "\u54ea\u4e9b", "\u600e\u4e48", "\u5982\u4f55", "\u8bf7\u7ed9", "\u7ed9\u51fa", "\u8bf4\u660e", "\u67e5\u8be2", "\u67e5\u627e", "\u76f8\u5173", "\u5185\u5bb9", "\u6587\u6863", "\u6750\u6599")
#: Hint words appended by query type; other types take the first (fixed values).
SCENARIO_HINTS = {"fact_lookup": "\u5b9a\u4e49 \u5bf9\u5e94\u7ae0\u8282", "table_qa": "\u6307\u6807 \u6570\u503c \u5355\u4f4d \u8868\u5934", "citation_locate": "\u539f\u6587\u51fa\u5904 \u6807\u9898\u8def\u5f84 \u7ae0\u8282 \u539f\u6587\u7247\u6bb5"}


def concise(question: Column) -> Column:
    """The question without politeness phrases and punctuation."""
    text = strip(F.coalesce(question, F.lit("")))
    short = F.regexp_replace(text, "(?iu)" + "|".join(PHRASES), " ")
    short = normalize_whitespace(F.regexp_replace(short, "[?\uff1f!\uff01,\uff0c\u3002\uff1b;\uff1a:\u3001]+", " "), False)
    return F.when(short != "", short).otherwise(text)


def compact(question: Column) -> Column:
    """Its words, numbers and CJK runs without stop words."""
    short = concise(question)
    found = F.regexp_extract_all(short, F.lit("[A-Za-z][A-Za-z0-9_\\-/.%]*|[0-9]+(?:\\.[0-9]+)?%?|[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    kept = F.array_join(F.filter(found, lambda t: ~t.isin(*STOP_WORDS)), " ")
    return F.when(kept != "", kept).otherwise(short)


def scenario(question: Column, query_type: Column) -> Column:
    hints = F.create_map(*[F.lit(x) for pair in SCENARIO_HINTS.items() for x in pair])
    return normalize_whitespace(F.concat_ws(" ", question, F.coalesce(hints[query_type], F.lit(SCENARIO_HINTS["fact_lookup"]))), False)


def variants(question: Column, query_type: Column, most: int = 4) -> Column:
    """The question, its rewrites and its scenario form: distinct without regard to case, in order, at most four."""
    asked = normalize_whitespace(question, False)
    found = F.filter(F.array(asked, concise(asked), compact(asked), scenario(asked, query_type)), lambda x: strip(x) != "")
    none = F.array().cast("array<string>")
    fresh = F.aggregate(found, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(fresh, 1, most)


def heading_level(c: Column) -> Column:
    """1 for numbered sections, 2 for CJK numerals with a mark, 3 for bracketed numerals, else 0."""
    text = normalize_whitespace(c, False)
    digits = "\u96f6\u3007\u4e00\u4e8c\u4e24\u4e09\u56db\u4e94\u516d\u4e03\u516b\u4e5d\u5341\u767e\u5343\u4e07"
    return (
        F.when(text.rlike("^[0-9]+\\s*[\u3001.\uff0e]\\s*.+$"), 0)
        .when(text.rlike(f"^\u7b2c\\s*[0-9{digits}]+\\s*\u8282(?:\\s+.*)?$"), 1)
        .when(text.rlike(f"^[{digits}]+\\s*[\u3001.\uff0e]\\s*.+$"), 2)
        .when(text.rlike(f"^[\uff08(]\\s*[0-9{digits}]+\\s*[)\uff09]\\s*.+$"), 3)
        .otherwise(0)
    )


def heading_path(*titles: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" > ", *[clean(t) for t in titles]), F.lit("")), F.lit("front_matter"))


#: Words by which a question asks for a table (fixed values).
TABLE_HINTS = ("table", "\u6307\u6807", "\u5355\u4f4d", "\u540c\u6bd4", "\u73af\u6bd4", "\u8868", "\u6570\u636e", "metric", "ratio", "revenue")
#: The hints of searches over routes; other types take the last (fixed values).
ROUTE_HINTS = {**SCENARIO_HINTS, "": "\u6838\u5fc3\u5173\u952e\u8bcd \u76f8\u5173\u7ae0\u8282"}


def asks_for_table(question: Column) -> Column:
    """A hint word, or four tokens or more with a digit among the characters."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return contains_any(low, TABLE_HINTS) | ((F.size(coarse_tokens(low)) >= 4) & low.rlike("[0-9]"))


def route_hint(query_type: Column) -> Column:
    hints = F.create_map(*[F.lit(x) for pair in ROUTE_HINTS.items() for x in pair])
    return F.coalesce(hints[F.coalesce(query_type, F.lit(""))], F.lit(ROUTE_HINTS[""]))


def default_variants(question: Column, most: int) -> Column:
    """What a question is also searched by: its tokens, its CJK tokens as one, its first six ASCII tokens; distinct, and other than the question."""
    text = strip(F.coalesce(question, F.lit("")))
    tokens = coarse_tokens(text)
    ascii_ = F.filter(tokens, lambda t: t < "\u4e00")
    cjk = F.array_join(F.filter(tokens, lambda t: t >= "\u4e00"), "")
    found = F.array(F.array_join(tokens, " "), cjk, F.when(F.size(ascii_) >= 2, F.array_join(F.slice(ascii_, 1, 6), " ")).otherwise(""))
    return F.slice(F.array_distinct(F.filter(found, lambda x: (x != "") & (x != text))), 1, max(0, most)) if most > 0 else F.array().cast("array<string>")


def normalize_content(content: Column) -> Column:
    """The text of a message that is JSON: a string, an object's text, output_text or value (if a string), else its content, else the JSON; a list's texts a line each. Other texts as they are.

    Objects and lists are looked into two levels deep.
    """

    def inner(c: Column, deeper: int) -> Column:
        v = F.try_parse_json(c)
        schema = F.schema_of_variant(v)
        string = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
        below = (lambda x: inner(x, deeper - 1)) if deeper else (lambda x: normalize_whitespace(x))
        items = F.from_json(c, "array<string>")
        listed = normalize_whitespace(F.array_join(F.filter(F.transform(items, below), lambda x: x != ""), "\n"))
        held = F.get_json_object(c, "$.content")
        of_object = F.coalesce(*[F.when(string(f"$.{k}").isNotNull(), normalize_whitespace(string(f"$.{k}"))) for k in ("text", "output_text", "value")], F.when(held.isNotNull(), below(held)), F.to_json(v))
        return F.when(F.ltrim(c).startswith("{") & schema.startswith("OBJECT"), of_object).when(F.ltrim(c).startswith("[") & schema.startswith("ARRAY"), listed).otherwise(normalize_whitespace(c))

    return F.coalesce(inner(F.coalesce(content, F.lit("")), 1), F.lit(""))


def json_queries(answer: Column, most: int = 4) -> Column:
    """Queries that a model's answer lists: a JSON array, an object's queries, expanded_queries or items, in a fence or among other text; else its bullet lines. Distinct, at most `most`."""
    text = F.coalesce(answer, F.lit(""))
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    object_ = F.regexp_extract(body, "(?s)\\{.*\\}", 0)
    array = F.regexp_extract(body, "(?s)\\[.*\\]", 0)
    of = lambda c: F.from_json(c, "array<string>")
    named = F.coalesce(*[of(F.get_json_object(object_, f"$.{k}")) for k in ("queries", "expanded_queries", "items")])
    bullets = F.transform(F.regexp_extract_all(text, F.lit("(?m)^\\s*(?:[-*\u2022]|[0-9]+[.)\u3001])\\s*(\\S.*)$"), F.lit(1)), strip)
    found = F.coalesce(named, of(array), bullets)
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")), 1, most)


def canonical_hash(value: Column, length: int = 64) -> Column:
    """SHA-256 (its first digits) of a struct or map as JSON with sorted keys: the same whatever the order of the columns."""
    return F.substring(F.sha2(F.to_json(F.try_parse_json(F.to_json(value))), 256), 1, length)


def truncated(c: Column, tokens: int) -> Column:
    """The beginning that is at most so many tokens of four characters."""
    return F.substring(F.coalesce(c, F.lit("")), 1, max(0, tokens) * 4)
