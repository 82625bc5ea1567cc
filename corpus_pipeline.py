"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; the result is written
as Parquet and read again as the next stage's docs. All stages but the last return the columns of
documents. Their SQL is None: automata, MinHash, embeddings and merge rounds are not SQL, so the stages
are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, language_id, near_dups, secrets, sentencepiece_codec
from folioflow.llm.common import free_name, held_out, table, written

ORACLE_SQL = None
#: Per cent of Jaccard similarity from which documents of the pipeline are near duplicates; op9 has its own contract.
NEAR_DUPS = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or no letter); a missing lang is filled in.

    Without a labelled row there is no language to tell, so texts with letters stay as they are.
    """
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = free_name(docs, "_lang"), free_name(docs, "_lang_score")
    seen = language_id.identify(docs, model, pred=pred, score=score).where(F.col(pred) != "und")
    return seen.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the smallest id, nulls last, then the smallest hash of the text; of equal rows, one."""
    return near_dups.first_rows(docs, threshold=NEAR_DUPS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within the edit limit."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live-looking secrets; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether they decode to the text."""
    ids, decoded = sentencepiece_codec.result_names(docs)
    out = sentencepiece_codec.encode_decode(docs, sentencepiece_codec.piece_model_path())
    n, same = free_name(docs, "n_tokens"), free_name(docs, "round_trip")
    return out.withColumn(n, F.size(ids).cast("long")).withColumn(same, F.col(decoded).eqNullSafe(F.coalesce("text", F.lit("")))).drop(decoded)


STAGES = [
    ("language_id", identify_language),
    ("near_dups", drop_near_dups),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", done=(docs,) if i else ())
    return STAGES[-1][1](spark, docs, sf_dir)
