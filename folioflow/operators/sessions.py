"""Interview sessions: opening, closing, and which answers fit what was issued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def open_or_reuse(users: DataFrame, sessions: DataFrame, fresh: Column) -> DataFrame:
    """(user, session_id, reused): each user's latest open session, else a new one with the id `fresh` (over user)."""
    last = sessions.where(F.col("completed_at").isNull()).groupBy("user").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("open"))
    return users.select("user").distinct().join(last, "user", "left").select("user", F.coalesce("open", fresh).alias("session_id"), F.col("open").isNotNull().alias("reused"))


def close(sessions: DataFrame, done: DataFrame) -> DataFrame:
    """sessions with completed_at of `done` (session_id, at) where they are still open; a closed session keeps its time."""
    at = done.groupBy("session_id").agg(F.min("at").alias("_at"))
    return sessions.join(at, "session_id", "left").withColumn("completed_at", F.coalesce("completed_at", "_at")).drop("_at")


def handshake(log: DataFrame, order: list[str]) -> DataFrame:
    """log (session_id, kind issue or answer, item) with `accepted` for answers.

    An answer counts if its item is the one issued last and nothing was accepted since; acceptance clears the
    issue, a refused answer does not. An issue without item (nothing left) clears it too.
    """
    w = Window.partitionBy("session_id").orderBy(*order)
    issue = F.col("kind") == "issue"
    turn = log.withColumn("_turn", F.count_if(issue).over(w))
    staged = F.max(F.when(issue, F.col("item"))).over(Window.partitionBy("session_id", "_turn"))
    fits = (F.col("kind") == "answer") & (F.col("_turn") > 0) & F.coalesce(F.col("item") == F.col("_staged"), F.lit(False))
    nth = F.sum(fits.cast("int")).over(Window.partitionBy("session_id", "_turn").orderBy(*order))
    return turn.withColumn("_staged", staged).withColumn("accepted", F.when(F.col("kind") == "answer", fits & (nth == 1))).drop("_turn", "_staged")


def session_counts(log: DataFrame) -> DataFrame:
    """(session_id, seen, refused, n_<choice>...): what handshake() let through, counted anew from the answers."""
    hit = F.coalesce("accepted", F.lit(False))
    return log.groupBy("session_id").agg(F.count_if(hit).alias("seen"), F.count_if(~hit & (F.col("kind") == "answer")).alias("refused"), F.count_if(hit & (F.col("choice") == "save_later")).alias("saved"))
