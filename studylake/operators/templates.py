"""Prompt templates: a catalogue, validation of placeholders, overrides, and rendering in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .routing import ACTIONS

PLACEHOLDER = r"\{\{\s*([A-Za-z][A-Za-z0-9]*)\s*\}\}"
ENVELOPE = ("contextTier", "articleContext", "selectedAnchor", "neighboringBlock", "discussionBranch", "curatedNotes", "action", "request", "contract")

#: Keys with their variables, those that must occur, and the default text.
_SPECIAL = [
    ("system.reading-partner", (), (), "Help the reader with the article alone. Say so where it gives no answer."),
    ("user.envelope", ENVELOPE, ("articleContext", "action", "request"), "".join(f"[{v}]\n{{{{{v}}}}}\n" for v in ENVELOPE)),
    ("scope.answer", ("action", "answerText"), ("action", "answerText"), "Apply {{action}} to this answer:\n{{answerText}}"),
    ("scope.thread", ("action",), ("action",), "Apply {{action}} to the discussion so far."),
    ("scope.document", ("action",), ("action",), "Apply {{action}} to the whole article."),
    ("visual-recap.repair", ("invalidOutput",), ("invalidOutput",), "Give this again as valid JSON of the agreed shape:\n{{invalidOutput}}"),
    ("visual-recap.image", ("visualRecapJson",), ("visualRecapJson",), "Draw one page from this outline:\n{{visualRecapJson}}"),
    ("context.cache-generation", ("briefMax", "studyMax", "articleText"), ("briefMax", "studyMax", "articleText"), "Write a brief of {{briefMax}} and notes of {{studyMax}} tokens at most.\n{{articleText}}"),
    ("routing.classifier-system", (), (), "Answer with one word: quick, standard or deep."),
]
CATALOGUE = [
    *_SPECIAL,
    *((f"request.{a}", (), (), f"Please do this with the selection: {a}.") for a in ACTIONS if a != "ask"),
    *((f"contract.{a}", (), (), f"Answer in the form that {a} asks for, and cite the article.") for a in ACTIONS),
]
SCHEMA = "key string, category string, default_template string, variables array<string>, required_variables array<string>"


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a table (TPL-1)."""
    return spark.createDataFrame([(k, k.split(".")[0], text, list(v), list(r)) for k, v, r, text in CATALOGUE], SCHEMA)


def effective(templates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each template's text, an override before the default (TPL-4)."""
    own = overrides.select("key", F.col("template").alias("__own"))
    return templates.join(own, "key", "left").select("*", F.coalesce("__own", "default_template").alias("template"), F.col("__own").isNotNull().alias("overridden")).drop("__own")


def save(overrides: DataFrame, saved: DataFrame, templates: DataFrame) -> DataFrame:
    """Overrides after saving ``(key, template)``: a text equal to the default deletes the override (TPL-4)."""
    rest = overrides.join(saved.select("key"), "key", "left_anti").select("key", "template")
    new = saved.join(templates.select("key", "default_template"), "key").where("template <> default_template").select("key", "template")
    return rest.unionByName(new)


def validate(templates: DataFrame, column: str = "template") -> DataFrame:
    """``unknown``, ``missing`` and ``malformed`` of each template, and whether it is ``valid`` (TPL-2)."""
    found = F.array_distinct(F.regexp_extract_all(column, F.lit(PLACEHOLDER), F.lit(1)))
    rest = F.regexp_replace(column, PLACEHOLDER, "")
    out = templates.select("*", F.array_except(found, "variables").alias("unknown"), F.array_except("required_variables", found).alias("missing"), (F.contains(rest, F.lit("{{")) | F.contains(rest, F.lit("}}"))).alias("malformed"))
    return out.withColumn("valid", (F.size("unknown") == 0) & (F.size("missing") == 0) & ~F.col("malformed"))


def render(template: Column | str, values: dict[str, Column]) -> Column:
    """The template with values for its placeholders, '' for those without one (TPL-3).

    One pass: what a value holds is never taken for a placeholder. Texts between the placeholders and their names are
    two arrays, zipped.
    """
    template = F.lit(template) if isinstance(template, str) else template
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    pieces = F.split(template, PLACEHOLDER, -1)
    value = lambda name: reduce(lambda acc, kv: acc.when(name == kv[0], F.coalesce(kv[1], F.lit(""))), values.items(), F.when(F.lit(False), "")).otherwise("")
    return F.array_join(F.zip_with(pieces, names, lambda p, n: F.concat(p, F.when(n.isNull(), "").otherwise(value(n)))), "")


def request_key(action: Column, scope: Column) -> Column:
    """Template of a request, null where the reader's own words are the request (TPL-5)."""
    scoped = F.when(scope.isin("answer", "thread", "document"), F.concat(F.lit("scope."), scope))
    return F.when(action != "ask", F.coalesce(scoped, F.concat(F.lit("request."), action)))


def contract_key(action: Column) -> Column:
    return F.concat(F.lit("contract."), action)
