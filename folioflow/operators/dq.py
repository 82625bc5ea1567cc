"""Data-quality rules as DataFrames of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import doi_normalize


def check_enum(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(domain)).groupBy(F.lit(f"enum:{column}").alias("rule"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("unique:" + ",".join(keys)).alias("rule"), F.concat_ws("|", *keys).alias("value"), "n")


def check_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, failed): names of the rules that a row breaks; a null rule counts as broken."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, failed.alias("failed")).where(F.size("failed") > 0)


def scored_candidate_rules() -> dict[str, Column]:
    """Contract of a scored candidate: five parts, their maximum as composite, a quote for high scores."""
    parts = [F.col(f"d{i}") for i in range(1, 6)]
    return {
        "composite_is_max": F.col("composite") == F.greatest(*parts),
        "parts_in_range": F.greatest(*parts).between(0, 10) & (F.least(*parts) >= 0),
        "high_needs_quote": (F.col("composite") < 7) | (F.length(F.trim(F.coalesce("quote", F.lit("")))) > 0),
        "has_title": F.length(F.trim(F.coalesce("title", F.lit("")))) > 0,
    }


def coverage(x: str | Column) -> Column:
    """A fraction clamped to 0..1; what is no number is null."""
    v = (F.col(x) if isinstance(x, str) else x).try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def readiness(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, ready) of the tables a run needs."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")).withColumn("ready", F.col("n_rows") > 0)
        out = one if out is None else out.unionByName(one)
    return out


def scout_contract(units: DataFrame, candidates: DataFrame, tops: DataFrame, barred: DataFrame, least: int = 3, bar: int = 7) -> DataFrame:
    """(unit_id, problem): what a unit's search result breaks, one row a problem.

    candidates: unit_id, position, doi, title, d1 to d5, composite, quote; tops: unit_id, doi, composite, grounding; barred: unit_id, doi, what
    must not be recommended. Equal candidates of a unit count each.
    """
    ids = units.select("unit_id").distinct()
    w = Window.partitionBy("unit_id").orderBy("position")
    # How much a candidate's score exceeds the one before it; a unit's candidates are capped by the search.
    steps = candidates.withColumn("rise", F.col("composite") > F.lag("composite").over(w))
    parts = [F.coalesce(F.col(f"d{i}"), F.lit(0)) for i in range(1, 6)]
    high = F.greatest(*parts)
    per = steps.groupBy("unit_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("rise"), F.lit(False)).alias("rises"))
    of_units = ids.join(per, "unit_id", "left").select("unit_id", F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) < least, F.concat(F.lit("candidates: "), F.coalesce("n", F.lit(0)).cast("string"))), F.when(F.col("rises"), "not in descending order"))).alias("p"))
    name = F.coalesce("doi", F.lit("-"))
    of_rows = candidates.join(ids, "unit_id", "left_semi").select("unit_id", F.array_compact(F.array(F.when(~F.col("composite").eqNullSafe(high), F.concat(name, F.lit(": composite is not the maximum"))), F.when((high >= bar) & (F.trim(F.coalesce("quote", F.lit(""))) == ""), F.concat(name, F.lit(": high without a quote"))))).alias("p"))
    known = barred.select("unit_id", doi_normalize("doi").alias("_doi")).distinct().withColumn("_barred", F.lit(True))
    top = tops.join(ids, "unit_id", "left_semi").withColumn("_doi", doi_normalize("doi")).join(known, ["unit_id", "_doi"], "left")
    of_tops = top.select("unit_id", F.array_compact(F.array(F.when(F.coalesce("composite", F.lit(0)) < bar, "top below the bar"), F.when(F.trim(F.coalesce("grounding", F.lit(""))) == "", "top without grounding"), F.when(F.col("_barred"), F.concat(F.lit("top is barred: "), F.col("_doi"))))).alias("p"))
    return of_units.unionByName(of_rows).unionByName(of_tops).select("unit_id", F.explode("p").alias("problem"))


def active(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold a rule, violators): a null is a violation, so no row is in neither."""
    ok = F.coalesce(rule, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def paper_scores(scores: DataFrame) -> DataFrame:
    """(unit_id, item, score, mean_score, member): a paper's score for a unit is the best of its members' scores, each the maximum of d1 to d5.

    scores: unit_id, member, item, d1 to d5. Of members with one score the one with the higher mean counts, then the first by name.
    """
    parts = [F.coalesce(F.col(f"d{i}"), F.lit(0)) for i in range(1, 6)]
    each = scores.select("unit_id", "item", "member", F.greatest(*parts).alias("score"), (sum(parts[1:], parts[0]) / 5).alias("mean_score"))
    best = F.min_by(F.struct("score", "mean_score", "member"), F.struct(-F.col("score"), -F.col("mean_score"), F.col("member")))
    return each.groupBy("unit_id", "item").agg(best.alias("b")).select("unit_id", "item", "b.*")
