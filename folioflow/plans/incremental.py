"""Queries that read on from a mark or fill up what is missing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import embedding
from folioflow.plans.base import table
from folioflow.sources.scratch import shared_dir
from folioflow.streaming import history


def replies_since(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as channels, assistants as bots: what users wrote after the first turn was sent, or in the thread of it."""
    t = table(spark, d, "conversations")
    messages = t.select(F.col("conv_id").alias("channel"), F.col("turn").alias("ts"), F.col("role").alias("user"), "text", F.when(F.col("turn") % 4 == 2, F.lit(0)).cast("long").alias("thread_ts"), (F.col("role") == "assistant").alias("is_bot"))
    sent = t.where("turn = 0").select(F.col("conv_id").alias("member"), F.col("conv_id").alias("channel"), F.when(F.col("conv_id") % 3 == 0, F.lit(3)).otherwise(0).cast("long").alias("ts"))
    return history.replies_since(messages, sent).select("member", "since", "ts", F.md5("text").alias("md5"))


REPLIES_SINCE = """WITH s AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 0 END AS since FROM conversations WHERE turn = 0),
m AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 4 = 2 THEN 0 END AS thread FROM conversations WHERE coalesce(role <> 'assistant', TRUE) AND coalesce(text, '') <> '')
SELECT conv_id AS member, CAST(since AS BIGINT) AS since, turn AS ts, md5(min(text)) AS md5 FROM m JOIN s USING (conv_id) WHERE turn > since OR (thread = since AND turn <> since) GROUP BY ALL"""


def history_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in three deliveries, the third with all of the first again: a file stream stores each turn once."""
    base = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    rows = table(spark, d, "conversations").withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn")))
    part = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    for wanted in ([0], [1], [2, 0]):
        rows.where(part.isin(wanted)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        history.store_history(stream, f"{base}/store", f"{base}/log", f"{base}/checkpoint", ["conv_id", "turn"]).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return history.read_store(spark, f"{base}/store", schema).select("conv_id", "turn", F.concat_ws("|", "role", "text").alias("said"))


HISTORY_DELIVERIES = "SELECT conv_id, turn, concat_ws('|', arg_min(role, s), arg_min(text, s)) AS said FROM (SELECT *, concat_ws('|', role, text) AS s FROM conversations) GROUP BY conv_id, turn"


def embedding_job(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents in scope that have none of this model; the tests work them out anew."""
    docs = table(spark, d, "documents")
    verdicts = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 0).alias("is_lab_relevant"))
    have = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.lit(f"hash-{embedding.DIM}").alias("model_name"))
    model = embedding.encoder("local", {"local": embedding.local_encoder(docs)})
    return embedding.embed_missing(docs.select("doc_id", "text"), verdicts, have, model, key="doc_id")


QUERIES = {f.__name__: f for f in (replies_since, history_deliveries, embedding_job)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
