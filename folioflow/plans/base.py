"""The driver's tables in the roles of the data model, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_YEAR = 2026
STOP = ["that", "with", "this", "from", "have"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    """documents as papers: the first sentence is the title; year, DOI and kind follow from the id."""
    i = F.col("doc_id")
    title = F.regexp_extract("text", r"^[^.!?\n]*", 0)
    doi = F.when(i % 5 == 0, F.lit(None)).when(i % 3 == 0, F.concat(F.lit("10.1101/p"), (i % 200).cast("string"), F.lit("_v"), (i % 4).cast("string"))).otherwise(F.concat(F.lit("10.1038/s"), (i % 400).cast("string")))
    return table(spark, d, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars", title.alias("title"), doi.alias("doi"), (2005 + i % 21).cast("int").alias("year"), (i % 3 == 0).alias("is_preprint"), (F.col("n_chars") / 100).cast("int").alias("page_count"),
    )


PAPERS = r"""papers AS (
  SELECT doc_id, text, lang, source, n_chars, regexp_extract(text, '^[^.!?\n]*', 0) AS title,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '10.1101/p' || (doc_id % 200) || '_v' || (doc_id % 4) ELSE '10.1038/s' || (doc_id % 400) END AS doi,
    CAST(2005 + doc_id % 21 AS INTEGER) AS year, doc_id % 3 = 0 AS is_preprint, CAST(floor(n_chars / 100.0) AS INTEGER) AS page_count
  FROM documents)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """events as answers: the user, the item in props, the choice by event type."""
    choice = F.when(F.col("event_type") == "view", "already_read").when(F.col("event_type") == "error", "not_relevant").when(F.col("event_type") == "signup", "skipped").otherwise("save_later")
    item = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("user"), item.alias("item"), choice.alias("choice"), "value")


ANSWERS = """answers AS (
  SELECT event_id, ts, user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
    CASE event_type WHEN 'view' THEN 'already_read' WHEN 'error' THEN 'not_relevant' WHEN 'signup' THEN 'skipped' ELSE 'save_later' END AS choice, value
  FROM events)"""

CHUNK = "CASE WHEN greatest(0, 2026 - {y}) < 5 THEN 'recent' WHEN greatest(0, 2026 - {y}) < 10 THEN 'mid' ELSE 'classic' END"
