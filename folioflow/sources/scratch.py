"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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
    """Write df as Parquet into the shared folder and read it back.

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
