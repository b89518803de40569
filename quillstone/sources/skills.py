"""Skills and gold cases from Markdown, checked: a faulty file is a row with its reasons, not an error.

A skill file holds a fenced block of JSON (its metadata) and sections under
`## ` headings. Files are read as whole texts by Spark, from any store that it
reads, and taken apart by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, normalize_whitespace, strip

#: The fields that metadata must have.
REQUIRED_FIELDS = ("skill_name", "query_types", "required_slots", "tool_chain", "guardrails", "slot_schema", "execution_config", "few_shot_examples", "tool_constraints")

_KIND = "skill_name string, query_types array<string>, required_slots array<string>, tool_chain array<string>, trace_fields array<string>, guardrails map<string,string>, slot_schema map<string,string>, tool_constraints map<string,string>, execution_config map<string,string>, few_shot_examples array<string>, task_description string, prompt_template string"


def _sections(text: Column) -> Column:
    """map of a section's heading, in lower case, to its text; of equal headings the last counts."""
    parts = F.split(F.concat(F.lit("\n"), text), "\\n##[ \\t]+")
    named = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.lower(strip(F.substring_index(p, "\n", 1))).alias("key"), strip(F.regexp_replace(p, "^[^\\n]*\\n?", "")).alias("value")))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(named, empty, lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["key"]), F.create_map(x["key"], x["value"])))


def _texts(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: normalize_whitespace(x, False)), lambda x: x != "")


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """A row for each Markdown file: path, the skill's columns, and reasons (empty for a skill that can be used).

    Reasons: `no metadata` (no fenced block), `no object` (the block is no JSON
    object), `missing <field>`, `empty skill_name`, `empty task_description`,
    `empty prompt_template`, `duplicate skill_name` (each of the files that
    share it). Sections win over metadata for description and template.
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\\r\\n?", "\n").alias("text"))
    block = F.regexp_extract("text", "(?s)```(?:json)?[ \\t]*\\n(.*?)\\n```", 1)
    rows = files.withColumns({"block": F.nullif(block, F.lit("")), "sections": _sections(F.col("text"))})
    rows = rows.withColumns({"fields": F.json_object_keys("block"), "m": F.from_json("block", _KIND)})
    of = lambda section, field: F.coalesce(clean(F.col("sections")[section]), clean(F.col("m")[field]), F.lit(""))
    rows = rows.select("path", "block", "fields", F.coalesce(clean(F.col("m.skill_name")), F.lit("")).alias("skill_name"), *[_texts(F.col(f"m.{c}")).alias(c) for c in ("query_types", "required_slots", "tool_chain", "trace_fields")], *[F.col(f"m.{c}").alias(c) for c in ("guardrails", "slot_schema", "tool_constraints", "execution_config", "few_shot_examples")], of("task description", "task_description").alias("task_description"), of("prompt template", "prompt_template").alias("prompt_template"))
    # a row for each file of a folder
    same = F.count("*").over(Window.partitionBy("skill_name")) > 1
    usable = F.col("fields").isNotNull()
    faults = [F.when(F.col("block").isNull(), "no metadata"), F.when(F.col("block").isNotNull() & ~usable, "no object")]
    faults += [F.when(usable & ~F.array_contains("fields", f), f"missing {f}") for f in REQUIRED_FIELDS]
    faults += [F.when(usable & (F.col(c) == "") & (F.array_contains("fields", c) if c == "skill_name" else F.lit(True)), f"empty {c}") for c in ("skill_name", "task_description", "prompt_template")]
    faults += [F.when((F.col("skill_name") != "") & same, "duplicate skill_name")]
    return rows.withColumn("reasons", F.array_compact(F.array(*faults))).drop("block", "fields")


def usable(skills: DataFrame) -> DataFrame:
    return skills.where(F.size("reasons") == 0)


def for_questions(questions: DataFrame, skills: DataFrame) -> DataFrame:
    """questions (qid, query_type, slots) with skill_name, tool_chain and missing: the skill's needed slots that are empty.

    Of several skills for a type the first by name. A type without a skill has
    nulls. slots is a struct or a map; a needed slot that it doesn't know is
    missing, and compare_targets needs two.
    """
    by_type = usable(skills).select(F.explode("query_types").alias("query_type"), "skill_name", "tool_chain", "required_slots")
    best = by_type.groupBy("query_type").agg(F.min_by(F.struct("skill_name", "tool_chain", "required_slots"), "skill_name").alias("s")).select("query_type", "s.*")
    slots = F.from_json(F.to_json("slots"), "map<string,string>")
    value = lambda name: F.coalesce(slots[name], F.lit(""))
    few = lambda name: F.coalesce(F.size(F.from_json(value(name), "array<string>")), F.lit(0)) < 2
    empty = lambda name: F.when(name == "compare_targets", few(name)).otherwise(F.trim(value(name)).isin("", "[]"))
    # a row for each query type
    out = questions.join(F.broadcast(best), "query_type", "left")
    return out.withColumn("missing", F.filter("required_slots", empty)).drop("required_slots")


def _cells(lines: DataFrame, least: int) -> DataFrame:
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), "^\\||\\|$", ""), "\\|"), strip)
    return lines.where(F.trim("value").startswith("|")).select(cells.alias("c")).where(F.size("c") >= least)


def gold_routes(lines: DataFrame) -> DataFrame:
    """Route cases of a Markdown table (column value): case_id, question, turn_type, context_source, effective_question, history_refs."""
    rows = _cells(lines, 8).where(F.startswith(F.col("c")[0], F.lit("route_")))
    at = lambda i: F.get("c", F.lit(i))
    refs = F.filter(F.transform(F.split(at(7), "[,，]"), strip), lambda x: ~x.isin("", "-"))
    return rows.select(at(0).alias("case_id"), at(3).alias("question"), at(4).alias("turn_type"), at(5).alias("context_source"), at(6).alias("effective_question"), refs.alias("history_refs"))
