"""Sources: HTML pages, parsed block payloads, Markdown, file listings, skills and gold cases."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_whitespace

_SPAN = "struct<content:string,type:string,html:string>"
_LINES = f"array<struct<spans:array<{_SPAN}>>>"
#: A parsed document: pages of blocks.
PAYLOAD = f"struct<source:string,pdf_path:string,pdf_info:array<struct<page_idx:int,page_size:array<double>,para_blocks:array<struct<index:int,type:string,bbox:array<double>,lines:{_LINES},table_rows:array<array<string>>,blocks:array<struct<lines:{_LINES}>>>>>>>"


#: Character references by name: those of HTML's first two sets of symbols and Latin letters, by the standard library's table.
_NAMED = {name: chr(code) for name, code in name2codepoint.items() if name != "amp"}


def unescape(c: Column) -> Column:
    """Character references by name and number, each read once (so &amp;lt; is &lt;)."""
    parts = F.split(c, "(?=&)")
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, "^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,10});", 1)
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 9), 16, 10)).when(ref.startswith("#"), F.substring(ref, 2, 9)).cast("long")
        # from a code point to its character by way of UTF-32
        char = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        found = F.when(ref == "amp", "&").when(ref != "", F.coalesce(char, names[ref]))
        return F.when(found.isNotNull(), F.concat(found, F.substring(part, F.length(ref) + 3, F.length(part)))).otherwise(part)

    # texts without a reference, which most are, stay as they are
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def html_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, tag, type, text): headings, paragraphs and list items of the body in order."""
    body = F.regexp_replace(F.col("html"), "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit("(?is)<(?:h[1-6]|p|li)\\b[^>]*>.*?(?=</?(?:h[1-6]|p|li|ul|ol|div|article|footer|nav|table|body)\\b|$)"), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("place", "raw"))
    tag = F.lower(F.regexp_extract("raw", "^<([A-Za-z0-9]+)", 1))
    text = normalize_whitespace(unescape(F.regexp_replace("raw", "<[^>]*>", " ")), False)
    rows = rows.select(key, "place", tag.alias("tag"), text.alias("text")).where("text <> ''")
    return rows.withColumn("type", F.when(F.col("tag").startswith("h"), "title").when(F.col("tag") == "li", "list").otherwise("text"))


def html_tables(html: Column) -> Column:
    """array<array<array<string>>>: the cells of the tables, entities resolved; all-blank rows are dropped."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit("(?is)<t[dh]\\b[^>]*>(.*?)(?=<t[dh]\\b|</t[dhr]\\s*>|$)"), F.lit(1)), lambda c: normalize_whitespace(unescape(F.regexp_replace(c, "<[^>]*>", " ")), False))
    rows = lambda table: F.transform(F.regexp_extract_all(table, F.lit("(?is)<tr\\b[^>]*>(.*?)(?=<tr\\b|</tr\\s*>|</table|$)"), F.lit(1)), cells)
    tables = F.regexp_extract_all(html, F.lit("(?is)<table\\b.*?(?:</table\\s*>|$)"), F.lit(0))
    return F.transform(tables, lambda t: F.filter(rows(t), lambda r: F.exists(r, lambda c: c != "")))


def payload_blocks(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, page_idx, block_index, place, type, text, rows, table_id) of parsed documents.

    Pages are ordered by page_idx, blocks by index; unknown types are text,
    empty blocks go; tables are numbered through the document.
    """
    pages = payloads.select(key, F.explode(f"{payload}.pdf_info").alias("p"))
    blocks = pages.select(key, F.col("p.page_idx").alias("page_idx"), F.posexplode("p.para_blocks").alias("at", "b"))
    spans = lambda lines: F.array_join(F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: F.coalesce(s["content"], F.lit(""))))), "")
    inner = F.array_join(F.transform(F.coalesce("b.blocks", F.array().cast(f"array<struct<lines:{_LINES}>>")), lambda x: spans(x["lines"])), "")
    text = normalize_whitespace(F.coalesce(F.nullif(spans(F.col("b.lines")), F.lit("")), inner))
    kind = F.when(F.col("b.type").isin("title", "text", "list", "table"), F.col("b.type")).otherwise("text")
    html = F.array_join(F.flatten(F.transform(F.col("b.lines"), lambda x: F.transform(x["spans"], lambda s: F.coalesce(s["html"], F.lit(""))))), "")
    parsed = F.get(html_tables(html), F.lit(0))
    rows = F.coalesce(F.when(F.size("b.table_rows") > 0, F.col("b.table_rows")), F.when(F.size(parsed) > 0, parsed), F.when(text != "", F.array(F.array(F.lit("table_text")), F.array(text))))
    out = blocks.select(key, "page_idx", F.coalesce("b.index", "at").alias("block_index"), kind.alias("type"), text.alias("text"), F.when(kind == "table", rows).alias("rows")).where("text <> '' or size(rows) > 0")
    place = F.concat_ws("", F.lpad(F.col("page_idx").cast("string"), 9, "0"), F.lpad(F.col("block_index").cast("string"), 9, "0"))
    out = out.withColumn("place", place)
    n = F.sum((F.col("type") == "table").cast("int")).over(Window.partitionBy(key).orderBy("page_idx", "block_index"))
    return out.withColumn("table_id", F.when(F.col("type") == "table", F.concat(F.lit("table_"), n)))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromDDL(f"payload {PAYLOAD}")["payload"].dataType
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.struct("*").alias("payload"), F.input_file_name().alias("path"))


def markdown_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraphs, parted by empty lines; lines that start with # are titles."""
    rows = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n[ \\t]*\n")).alias("place", "raw"))
    rows = rows.withColumn("text", normalize_whitespace(F.regexp_replace("raw", "^\\s*#+\\s*", ""))).where("text <> ''")
    return rows.select(key, "place", F.when(F.ltrim("raw").startswith("#"), "title").otherwise("text").alias("type"), "text")


def read_files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, sha256 and size of the files under a folder, in order of the path without regard to case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("doc_hash"), F.col("length").alias("size")).orderBy(F.lower("path"), "path")


def page_splits(documents: DataFrame, pages: str = "page_count", most: int = 200) -> DataFrame:
    """Page ranges of at most so many pages for documents too long to parse at once."""
    parts = documents.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(pages) / most).cast("int") - 1))))
    return parts.withColumn("first_page", F.col("part") * most).withColumn("last_page", F.least(F.col(pages), (F.col("part") + 1) * most) - 1)


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """Skills from Markdown files: the fenced JSON's name, query types and required slots."""
    text = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", "(?s)```json\\s*(.*?)```", 1)
    skill = F.from_json(block, "skill_name string, query_types array<string>, required_slots array<string>, tool_chain array<string>")
    return text.select(skill.alias("s")).select("s.*").where("skill_name is not null")


def gold_cases(lines: DataFrame) -> DataFrame:
    """Cases of a Markdown table (column value): id, question, keywords; the prefix tells the type."""
    cells = F.transform(F.split(F.btrim("value", F.lit("| ")), "\\|"), lambda x: F.trim(x))
    rows = lines.where(F.ltrim("value").startswith("|")).select(cells.alias("c")).where(F.size("c") >= 4)
    kind = F.regexp_extract(F.get("c", F.lit(0)), "^(skill_fact|skill_table|text|table|citation|summary|report|route)_", 1)
    types = F.create_map(*[F.lit(x) for p in (("text", "fact_lookup"), ("skill_fact", "fact_lookup"), ("table", "table_qa"), ("skill_table", "table_qa"), ("citation", "citation_locate"), ("summary", "summarization"), ("report", "report_generation")) for x in p])
    return rows.where((kind != "") & (kind != "route")).select(F.get("c", F.lit(0)).alias("case_id"), F.get("c", F.lit(1)).alias("question"), F.filter(F.split(F.get("c", F.lit(3)), "、"), lambda k: F.trim(k) != "").alias("keywords"), types[kind].alias("expected_type"))
