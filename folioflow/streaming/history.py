"""Message history that arrives in deliveries: each message is kept once, with a mark to read on from and an audit log.

A store is a folder with one partition a batch of the stream, and below it one a month, in files of a useful size that
are sorted by day: their number follows the rows, not the days. A batch that is run again
writes its own partition again, and compares with earlier batches only, so a replay changes nothing. The audit log
is written in the same way, after the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.readers import exists

LOG = "id string, applied_at timestamp, cycle_id string, change_type string, unit_id string, detail_json string, source string"


def replies_since(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """(member, channel, since, ts, user, text, thread_ts): what was written in a member's channel after the member's message was sent, or in its thread.

    messages: channel, ts, user, text, thread_ts, is_bot; sent: member, channel, ts. Rows of bots and rows without text
    go; of rows that a member has at one time the first by user and text stays. A null is_bot is no bot.
    """
    human = messages.where(~F.coalesce("is_bot", F.lit(False)) & (F.coalesce("text", F.lit("")) != "")).select("channel", "ts", "user", "text", "thread_ts")
    marks = sent.select("member", "channel", F.col("ts").alias("since")).distinct()
    met = human.join(marks, "channel").where((F.col("ts") > F.col("since")) | ((F.col("thread_ts") == F.col("since")) & (F.col("ts") != F.col("since"))))
    first = F.min_by(F.struct("channel", "since", "user", "text", "thread_ts"), F.struct("user", "text", "since", "channel"))
    return met.groupBy("member", "ts").agg(first.alias("r")).select("member", "r.channel", "r.since", "ts", "r.user", "r.text", "r.thread_ts")


def append_log(rows: DataFrame, path: str, run: str) -> None:
    """Appends audit rows (the columns of LOG) of one run; the same run again replaces its own rows and no others."""
    columns = [c.split()[0] for c in LOG.split(", ")]
    rows.select(*columns).write.mode("overwrite").parquet(f"{path}/run={run}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The audit log; empty where nothing was logged."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{LOG}, run string")
    return spark.read.schema(f"{LOG}, run string").option("basePath", path).parquet(path)


def _store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_store() with the month that the rows are stored under."""
    whole = f"{schema}, day date, batch long, _month date"
    if not exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(path)


def _month(day: Column) -> Column:
    return F.trunc(day, "month")


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All messages of a store, with batch and day; empty where nothing was stored."""
    store = _store(spark, path, schema).drop("_month")
    return store.select(*[c for c in store.columns if c not in ("batch", "day")], "batch", "day")


def read_since(spark: SparkSession, path: str, schema: str, batch: int, at: str = "ts", since: Column | None = None) -> DataFrame:
    """What batches after `batch` stored, if wanted only from a time on: an incremental read that opens no earlier partition."""
    if since is None:
        return read_store(spark, path, schema).where(F.col("batch") > batch)
    # The month is a folder, by which files are left out unopened.
    late = (F.col("_month") >= _month(F.to_date(since))) & (F.col("day") >= F.to_date(since)) & (F.col(at) >= since)
    return _store(spark, path, schema).where((F.col("batch") > batch) & late).select(*read_store(spark, path, schema).columns)


def mark(spark: SparkSession, log: str, source: str) -> int:
    """The last batch that the log has as stored, -1 without one: where an incremental reader goes on."""
    last = read_log(spark, log).where((F.col("change_type") == "history_append") & (F.col("source") == source)).agg(F.max(F.get_json_object("detail_json", "$.batch").cast("long"))).first()[0]
    return -1 if last is None else last


def store_batch(batch: DataFrame, number: int, path: str, log: str, keys: list[str], at: str = "ts", source: str = "history") -> None:
    """Appends the rows of a batch that no earlier batch stored; equal keys of a batch are one row, the smallest.

    Only the months of the batch are compared. Rows with a null key or time are of a day of their own and are
    told apart by the other columns like any others.
    """
    spark = batch.sparkSession
    others = [c for c in batch.columns if c not in keys]
    picked = batch.groupBy(*keys).agg(F.min_by(F.struct(*others), F.to_json(F.struct(*others))).alias("r")).select(*keys, "r.*") if others else batch.distinct()
    fresh = picked.select(*batch.columns).withColumn("day", F.to_date(at))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    old = _store(spark, path, schema).where(F.col("batch") < number)
    months = batch.select(_month(F.to_date(at)).alias("_month")).distinct()
    on = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*keys, "day"]]
    known = old.join(F.broadcast(months), old["_month"].eqNullSafe(months["_month"]), "left_semi").select(*keys, "day")
    new = fresh.alias("n").join(known.alias("o"), on, "left_anti").withColumn("_month", _month(F.col("day")))
    new.hint("rebalance", "_month").sortWithinPartitions("_month", "day").write.mode("overwrite").partitionBy("_month").parquet(f"{path}/batch={number}")
    stored = read_store(spark, path, schema).where(F.col("batch") == number).select(F.lit(0).alias("received"), F.lit(1).alias("stored"), F.col(at).alias("newest"))
    received = batch.select(F.lit(1).alias("received"), F.lit(0).alias("stored"), F.lit(None).cast(batch.schema[at].dataType).alias("newest"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counts = stored.unionByName(received).agg(total("received"), total("stored"), F.max("newest").cast("string").alias("newest"))
    detail = F.to_json(F.struct(F.lit(number).alias("batch"), "received", "stored", "newest"))
    row = counts.select(F.lit(f"{source}:{number}").alias("id"), F.current_timestamp().alias("applied_at"), F.lit(None).cast("string").alias("cycle_id"), F.lit("history_append").alias("change_type"), F.lit(None).cast("string").alias("unit_id"), detail.alias("detail_json"), F.lit(source).alias("source"))
    append_log(row, log, f"{source}-{number}")


def store_history(messages: DataFrame, path: str, log: str, checkpoint: str, keys: list[str], at: str = "ts", source: str = "history"):
    """Starts the stream: all that is there now, delivery by delivery, with store_batch(); returns the query."""
    write = lambda df, number: store_batch(df, number, path, log, keys, at, source)
    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
