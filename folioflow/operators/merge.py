"""Writes with a key: merges by policy, insert-if-absent, replacement of partitions, rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What becomes of a column when old and new row meet.
POLICIES = {
    "new": lambda o, n: n,
    "old": lambda o, n: o,
    "coalesce": lambda o, n: F.coalesce(n, o),
    "keep": lambda o, n: F.coalesce(o, n),
    "nonempty": lambda o, n: F.coalesce(F.nullif(n, F.lit("")), o),
    "longer": lambda o, n: F.when(F.coalesce(F.length(n), F.lit(0)) > F.coalesce(F.length(o), F.lit(0)), n).otherwise(o),
    "larger_array": lambda o, n: F.when(F.coalesce(F.size(n), F.lit(0)) > F.coalesce(F.size(o), F.lit(0)), n).otherwise(o),
    "or": lambda o, n: F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False)),
}


def last_rows(df: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """One row for each key, null keys too: the last one by `order`, and of equal ones the largest by the other columns, so the result is the same in any layout."""
    others = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order], *[F.to_json(F.struct(F.col(c))) for c in others])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), ranked).alias("_r")).select(*keys, "_r.*").select(*df.columns) if others else df.dropDuplicates(keys)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str, flag: str = "_hit") -> DataFrame:
    """left joined to right, whose keys are unique and whose other columns have names of their own; null keys meet each other."""
    named = right.withColumnsRenamed({k: f"_{i}_{k}" for i, k in enumerate(keys)})
    on = [left[k].eqNullSafe(named[f"_{i}_{k}"]) for i, k in enumerate(keys)]
    both = left.join(named, on, how)
    if how in ("left_semi", "left_anti"):
        return both
    if how == "full":
        # A row of right alone has no left key; `flag` tells it from a left row whose key is null.
        both = both.withColumns({k: F.when(F.col(flag).isNull(), F.col(f"_{i}_{k}")).otherwise(F.col(k)) for i, k in enumerate(keys)})
    return both.drop(*[f"_{i}_{k}" for i, k in enumerate(keys)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str], default: str = "new", protect: Column | None = None, protected: list[str] = (), order: list[str] = ()) -> DataFrame:
    """old with new merged in by keys. Where `protect` (over the old row's columns) holds, the protected columns keep the old value.

    Of new rows with one key the last by `order` counts (columns of new that old need not have; without them, or
    where they are equal, the largest row). Keys that are null are equal to each other. A key that old repeats stays
    repeated, and each of its rows is merged.
    """
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*columns).alias("_o"))
    n = last_rows(new.select(*keys, *columns, *[c for c in order if c not in old.columns]), keys, list(order)).select(*keys, F.struct(*columns).alias("_n"))
    both = null_safe(o, n, keys, "full", "_o")
    held = F.lit(False)
    if protect is not None:
        both = both.select("*", *[F.col(f"_o.{c}").alias(c) for c in columns])
        held = F.coalesce(protect, F.lit(False))
    out = []
    for c in columns:
        a, b = F.col("_o")[c], F.col("_n")[c]
        merged = F.when(F.col("_o").isNull(), b).when(F.col("_n").isNull(), a).otherwise(POLICIES[policies.get(c, default)](a, b))
        if c in protected:
            merged = F.when(held & F.col("_o").isNotNull(), a).otherwise(merged)
        out.append(merged.alias(c))
    return both.select(*keys, *out)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], first_by: list[str]) -> DataFrame:
    """Rows of new whose key is not in old; of equal keys in new the first. Null keys are equal to each other."""
    columns = [c for c in new.columns if c not in keys]
    firsts = new.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*first_by)).alias("r")).select(*keys, "r.*")
    return null_safe(firsts, old.select(*keys), keys, "left_anti")


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """old without the groups that new has, and new: what a dynamic partition overwrite leaves. Rows without a group are one group."""
    return null_safe(old, new.select(group).distinct(), [group], "left_anti").unionByName(new)


def overwrite_groups(new: DataFrame, path: str, group: str) -> None:
    """The same as a write: only the partitions that new has are replaced."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def missing_keys(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of expected that actual lacks, each once; null keys are equal to each other."""
    return null_safe(expected.select(*keys).distinct(), actual.select(*keys), keys, "left_anti")


def retire_choice(df: DataFrame, old: str, new: str, marker: str) -> DataFrame:
    """Rewrites a retired value of choice and leaves a marker in the map choice_detail; running it again changes nothing."""
    hit = F.col("choice") == old
    none = F.create_map().cast("map<string,string>")
    detail = F.coalesce("choice_detail", none)
    marked = F.when(F.map_contains_key(detail, marker), detail).otherwise(F.map_concat(detail, F.create_map(F.lit(marker), F.lit(old))))
    return df.withColumn("choice_detail", F.when(hit, marked).otherwise(F.col("choice_detail"))).withColumn("choice", F.when(hit, new).otherwise(F.col("choice")))
