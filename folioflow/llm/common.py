"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch hands to a Python worker; whole texts stay well under 100 MB a batch.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; where it is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Tables of earlier calls in `done` are deleted then, as no later plan reads them; the others go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = _path(spark, path)
    files.deleteOnExit(p)
    drop_written(*done)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by written() which no later plan reads."""
    for df in frames:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            files, p = _path(df.sparkSession, folder)
            files.delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch of whole texts takes in a Python worker.

    Spark reads this setting when a plan is run, so it stays lowered for the session; a lower value of the caller's is kept.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn labels from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def hot_keys(left: DataFrame, key: str, least: int = 10_000, share: int = 1_000, rows: int | None = None) -> list:
    """Keys with more than `least` rows and more than one in `share` of all rows: `share` keys at most, whatever the table's size.

    rows: a bound of the table's rows, if the caller knows one; within `least` no key can have more.
    """
    if rows is not None and rows <= least:
        return []
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") > least))
    big = counts.orderBy(F.desc("_n")).limit(share).collect()
    if not big:
        return []
    bar = left.count() / share
    return [r[0] for r in big if r["_n"] > bar]


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: list | None = None, salts: int = 64, rows: int | None = None) -> DataFrame:
    """left LEFT JOIN right on key, right having one row for each key: a hot key's rows go to `salts` tasks.

    Only the hot keys' rows of right are copied. `spread` is any column of left that differs within a key;
    hot is what hot_keys() says of left, and rows a bound of left's rows, if the caller knows them.
    """
    hot = hot_keys(left, key, rows=rows) if hot is None else hot
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
