"""Counters over variables that may be strings or objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.json_values import parsed_or


def _kind(v: Column) -> Column:
    """string, object or other."""
    schema = F.schema_of_variant(v)
    return F.when(schema == "STRING", "string").when(schema.startswith("OBJECT"), "object").otherwise("other")


def _list(v: Column, path: str) -> Column:
    """A list in a variant as array of variants; whatever else stands there is no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column) -> Column:
    """A string as it is, another value as JSON."""
    return F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _names(items: Column) -> Column:
    name = lambda v: F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string")).when(_kind(v) == "object", F.nullif(F.try_variant_get(v, "$.name", "string"), F.lit("")))
    return F.array_compact(F.transform(items, name))


def typed_counts(projects: DataFrame, variables: str = "variables") -> DataFrame:
    """(user, kind, key, n) over projects (user, variables), the latter a JSON text with independent_vars and dependent_vars.

    Each variable is a string or an object {name, values}; objects without a name have values only, other values are
    passed over. Kinds: iv_name, iv_value and dv_name, how often each occurs; compound, iv+dv, in how many projects both
    occur. Names and values of one project are bounded by its own text; projects of one user combine before the
    shuffle. A text that is no JSON has no variables.
    """
    parsed = projects.select("user", parsed_or(variables).alias("v"))
    lists = parsed.select("user", _list(F.col("v"), "$.independent_vars").alias("iv"), _list(F.col("v"), "$.dependent_vars").alias("dv"))
    named = lists.select("user", _names(F.col("iv")).alias("iv_names"), _names(F.col("dv")).alias("dv_names"), F.flatten(F.transform(F.filter("iv", lambda v: _kind(v) == "object"), lambda v: F.transform(_list(v, "$.values"), _text))).alias("iv_values"))
    compounds = F.array_distinct(F.flatten(F.transform("iv_names", lambda i: F.transform("dv_names", lambda d: F.concat(i, F.lit("+"), d)))))
    tagged = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    each = F.concat(tagged("iv_name", F.col("iv_names")), tagged("iv_value", F.col("iv_values")), tagged("dv_name", F.col("dv_names")), tagged("compound", compounds))
    return named.select("user", F.explode(each).alias("e")).groupBy("user", "e.kind", "e.key").agg(F.count("*").alias("n"))
