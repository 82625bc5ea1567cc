"""Synopses: from the JSON that was written to rows with a type, and what keeps a file out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.json_values import parsed_or
from folioflow.functions.text import one_of
from folioflow.operators.dq import coverage

# --- fixed values: lists of a synopsis, its states, and defaults ---------------------------------------
LISTS = ["key_assumptions", "manipulations", "key_findings", "interpretations", "limitations_noted", "connecting_signals"]
STATES = ["auto_unreviewed", "meta_reviewed", "human_approved", "needs_rework"]


def _text(v: Column) -> Column:
    """A string as it is, another value as JSON, null and JSON's null as null."""
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string")).when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _items(v: Column) -> Column:
    """A list's values as texts; another value is a list of one, none an empty list."""
    some = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)), F.array().cast("array<variant>"))
    return F.transform(some, lambda x: F.coalesce(_text(x), F.lit("null")))


def synopsis_rows(raw: DataFrame, now: Column, version: str, generator: str, states: list[str] = STATES) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): raw has canonical_id and body, a JSON text.

    Missing fields have defaults, an unknown state is the first of `states`, lists are lists of texts, the coverage is a number from 0 to 1.
    A body is skipped, with a reason, if it is no JSON object or if its frameworks are not all objects with a string as name.
    """
    v = raw.withColumn("v", F.try_parse_json("body")).withColumn("_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    field = lambda f: F.try_variant_get(F.col("v"), f"$.{f}", "variant")
    string = lambda f: _text(field(f))
    fw = field("frameworks")
    listed = F.coalesce(F.try_variant_get(fw, "$", "array<variant>"), F.when(fw.isNotNull() & ~F.is_variant_null(fw), F.array(fw)), F.array().cast("array<variant>"))
    named = lambda x: F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.name", "variant")) == "STRING", F.lit(False))
    why = F.when(~F.col("_object"), "no JSON object").when(~F.forall(listed, named), "frameworks")
    number = F.when(F.schema_of_variant(field("abstract_coverage")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), coverage(F.try_variant_get(F.col("v"), "$.abstract_coverage", "string")))
    text_or = lambda f, default: F.coalesce(F.nullif(string(f), F.lit("")), default)
    row = [
        text_or("synopsis_version", F.lit(version)).alias("synopsis_version"), F.transform(listed, lambda x: F.to_json(x)).alias("frameworks"), string("core_question").alias("core_question"), *[_items(field(c)).alias(c) for c in LISTS],
        string("out_of_scope_note").alias("out_of_scope_note"), text_or("generator", F.lit(generator)).alias("generator"), one_of(F.coalesce(string("review_status"), F.lit("")), states, states[0]).alias("review_status"),
        text_or("generated_at", now).alias("generated_at"), number.alias("abstract_coverage"),
    ]
    judged = v.withColumn("_why", why)
    return judged.where("_why IS NULL").select("canonical_id", *row), judged.where("_why IS NOT NULL").select("canonical_id", F.col("_why").alias("reason"))
