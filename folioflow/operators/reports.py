"""Counts that a run reports, and small joins that decorate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.merge import last_rows


def score_histogram(scored: DataFrame, score: str = "score", hard: str = "hard") -> DataFrame:
    """(bucket, n) of exclusion scores; a hard hit has its own bucket."""
    s = F.col(score)
    bucket = F.when(F.coalesce(hard, F.lit(False)), "hard").when(s <= -2, "<=-2").when(s <= 0, "-1..0").when(s <= 2, "1..2").otherwise(">=3")
    return scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def run_report(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row: the number of rows and how many of them each condition holds for; a null is no."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counters.items()])


def tier_counts(queue: DataFrame, by: str, tiers: list[str]) -> DataFrame:
    """(by, one column a tier): how many rows of each tier a queue or a unit's candidates have."""
    return queue.groupBy(by).pivot("tier", tiers).count().fillna(0)


def table_digest(df: DataFrame, by: str, columns: list[str], digits: int = 16) -> DataFrame:
    """(by, digest): changes if any row of the group changes, whatever their order; row hashes add up, so they combine before the shuffle."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    total = F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(by).agg(F.substring(F.sha2(F.concat_ws("|", total.cast("string"), F.count("*").cast("string")), 256), 1, digits).alias("digest"))


def with_flags(df: DataFrame, verdicts: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """df with the flags of its verdict; no verdict, or a null flag, counts as true. Of several verdicts of a key each flag holds that holds in all of them."""
    one = verdicts.groupBy(key).agg(*[F.bool_and(F.coalesce(f, F.lit(True))).alias(f) for f in flags])
    return df.join(one, key, "left").withColumns({f: F.coalesce(f, F.lit(True)) for f in flags})


def without_refused(df: DataFrame, verdicts: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows that no verdict refuses: missing and null verdicts keep them."""
    return df.join(verdicts.where(~F.coalesce(F.col(flag), F.lit(True))).select(key), key, "left_anti")


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, default: Column, order: list[str] = ()) -> DataFrame:
    """df with `value` of a lookup table, as many rows as df has; a missing key or a null value gives the default.

    Of several rows of a key the last by `order` (columns of table) wins, and of equal ones the one with the largest value.
    """
    one = last_rows(table.where(F.col(key).isNotNull()).select(key, value, *order), [key], list(order)).select(key, value)
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, default))


def nested(df: DataFrame, prefix: str, into: str, probes: list[str]) -> DataFrame:
    """Columns that begin with prefix become one struct, without the prefix; null where all the probes are null."""
    inner = [c for c in df.columns if c.startswith(prefix)]
    none = F.coalesce(*[F.col(f"{prefix}{p}").cast("string") for p in probes]).isNull()
    return df.withColumn(into, F.when(~none, F.struct(*[F.col(c).alias(c[len(prefix) :]) for c in inner]))).drop(*inner)


def first_source(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, source): where a key was seen first."""
    return rows.groupBy(key).agg(F.min_by("source", F.struct(order, "source")).alias("source"))


def with_fallback(mirror: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The mirror's rows, and those of the store for keys that the mirror lacks."""
    return mirror.unionByName(store.join(mirror.select(key), key, "left_anti"))


def fresh_tags(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Tags after a run: the run's own, and the old ones of other tagger versions; what the run did not write again is stale and goes."""
    versions = new.select("tagger_version").distinct()
    other = old.join(versions, "tagger_version", "left_anti").join(new.select(*keys), keys, "left_anti")
    return other.select(*new.columns).unionByName(new)


def mirrored(df: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """df with dim_tags, a map dim -> codes by strength, of the keys that have tags."""
    codes = tags.groupBy(key, "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "code"))), lambda x: x["code"]).alias("codes"))
    maps = codes.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "codes")))).alias("dim_tags"))
    return df.drop("dim_tags").join(maps, key, "left")
