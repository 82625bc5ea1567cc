"""Streams: replies drive a conversation per member; every tenth answer starts a review."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions.dates import cycle_id, cycle_start
from folioflow.operators import feedback

REMIND, GIVE_UP, DECIDE = timedelta(hours=24), timedelta(hours=24), timedelta(hours=12)
TERMINAL = ("decided", "passed", "timeout", "no_rec")
#: What a reply does to an open conversation.
AFTER = {"thumbs_up": "decided", "saved": "decided", "cited": "decided", "thumbs_down": "passed", "already_read": "passed", "thread_reply": "awaiting_decision"}


def due(state: str, due_at: datetime) -> tuple[str, datetime | None]:
    """The state after its deadline, and the next deadline."""
    return ("reminded", due_at + GIVE_UP) if state == "awaiting" else ("timeout", None)


def advance(state: str, due_at: datetime | None, last: datetime | None, ts: datetime, signal: str, picked: bool) -> tuple[str, datetime | None, datetime | None]:
    """State, deadline and last reply after a reply at ts; deadlines that passed before it come first."""
    while state not in TERMINAL and due_at is not None and due_at <= ts:
        state, due_at = due(state, due_at)
    if state in TERMINAL or (last is not None and ts <= last):
        return state, due_at, last
    state = "decided" if picked else AFTER.get(signal, "awaiting_decision")
    return state, (ts + DECIDE if state == "awaiting_decision" else None), ts


def run_conversation(start: datetime, replies: list[tuple[datetime, str, bool]], as_of: datetime) -> tuple[str, int]:
    """Final state and number of replies that counted."""
    state, due_at, last, n = "awaiting", start + REMIND, None, 0
    for ts, signal, picked in sorted(replies):
        before = last
        state, due_at, last = advance(state, due_at, last, ts, signal, picked)
        n += last != before
    while state not in TERMINAL and due_at is not None and due_at <= as_of:
        state, due_at = due(state, due_at)
    return state, n


def _expired(s, now: Column):
    """The state struct after one deadline at `now`."""
    over = s["due"].isNotNull() & (s["due"] <= now)
    first = s["state"] == "awaiting"
    state = F.when(over & first, "reminded").when(over, "timeout").otherwise(s["state"])
    due_at = F.when(over & first, s["due"] + _ms(GIVE_UP)).when(~over, s["due"])
    return F.struct(state.alias("state"), due_at.alias("due"), s["last"].alias("last"), s["n"].alias("n"))


def _ms(span: timedelta) -> int:
    return int(span.total_seconds() * 1000)


def conversations_batch(replies: DataFrame, as_of: datetime) -> DataFrame:
    """(member, cycle, state, reply_count) of replies (member, ts, signal, picked, idem_key) by weekly cycle, at as_of (UTC).

    The replies of one conversation are folded in order by the state machine, without leaving the JVM.
    """
    once = replies.dropDuplicates(["idem_key"]).withColumn("cycle", cycle_id(F.col("ts"))).withColumn("start", F.unix_millis(cycle_start(F.col("ts"))))
    said = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "signal", "picked")
    talks = once.groupBy("member", "cycle").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(said)).alias("said"))
    answer = lambda x: F.when(x["picked"], "decided").otherwise(F.coalesce(*[F.when(x["signal"] == k, v) for k, v in AFTER.items()], F.lit("awaiting_decision")))

    def step(acc, x):
        # Two deadlines at most lie before a reply; each is null in a terminal state.
        return F.transform(F.array(_expired(acc, x["ts"])), lambda s: F.transform(F.array(_expired(s, x["ts"])), lambda t: _heard(t, x, answer(x)))[0])[0]

    start = F.struct(F.lit("awaiting").alias("state"), (F.col("start") + _ms(REMIND)).alias("due"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("n"))
    end = F.lit(int(as_of.replace(tzinfo=UTC).timestamp() * 1000))
    last = F.aggregate("said", start, step, lambda s: F.transform(F.array(_expired(s, end)), lambda t: _expired(t, end))[0])
    return talks.select("member", "cycle", last.alias("s")).select("member", "cycle", "s.state", F.col("s.n").alias("reply_count"))


def _heard(s, x, state: Column):
    """The state struct after a reply that counts."""
    deaf = s["state"].isin(*TERMINAL) | F.coalesce(x["ts"] <= s["last"], F.lit(False))
    due_at = F.when(deaf, s["due"]).when(state == "awaiting_decision", x["ts"] + _ms(DECIDE))
    return F.struct(F.when(deaf, s["state"]).otherwise(state).alias("state"), due_at.alias("due"), F.when(deaf, s["last"]).otherwise(x["ts"]).alias("last"), (s["n"] + (~deaf).cast("int")).alias("n"))


def conversations_stream(replies: DataFrame) -> DataFrame:
    """The same as a stream: state by member and cycle, deadlines as event-time timeouts, a row for each change.

    A finished conversation is kept until its week is over, as late replies must still find it closed, and then removed.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    once = replies.withWatermark("ts", "7 days").dropDuplicatesWithinWatermark(["idem_key"]).withColumn("cycle", cycle_id(F.col("ts")))
    once = once.withColumns({"at": F.unix_millis(F.col("ts")), "start": F.unix_millis(cycle_start(F.col("ts")))})
    schema = "member long, cycle string, state string, reply_count int"
    at = lambda ms: None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)
    ms = lambda t: None if t is None else round(t.replace(tzinfo=UTC).timestamp() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        member, cycle = key
        state, due_at, last, n, end = held.get if held.exists else (None, None, None, 0, None)
        before, due_at, last = (state, n), at(due_at), at(last)
        if not held.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["at", "signal", "picked"])
            if state is None:
                start = int(rows["start"].iloc[0])
                state, due_at, end = "awaiting", at(start) + REMIND, start + _ms(timedelta(days=7))
            for ts, signal, picked in zip(rows["at"], rows["signal"], rows["picked"], strict=True):
                heard = last
                state, due_at, last = advance(state, due_at, last, at(int(ts)), signal, picked)
                n += last != heard
        now = held.getCurrentWatermarkMs()
        while state not in TERMINAL and due_at is not None and ms(due_at) <= now:
            state, due_at = due(state, due_at)
        if held.hasTimedOut and state in TERMINAL and end <= now:
            held.remove()
        else:
            held.update((state, ms(due_at), ms(last), n, end))
            held.setTimeoutTimestamp(max(now + 1, ms(due_at) if state not in TERMINAL and due_at is not None else end))
        yield pd.DataFrame([(member, cycle, state, n)] if (state, n) != before else [], columns=["member", "cycle", "state", "reply_count"])

    return once.groupBy("member", "cycle").applyInPandasWithState(run, schema, "state string, due long, last long, n int, end long", "update", GroupStateTimeout.EventTimeTimeout)


def reviews_stream(answers: DataFrame, every: int = 10) -> DataFrame:
    """(user, n_answers, saved, rejected) after every tenth answer, over the last ten."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = held.get if held.exists else (0, "")
        recent, out = kept.split("|") if kept else [], []
        for choice in pd.concat(list(batches)).sort_values("ts")["choice"]:
            n, recent = n + 1, [*recent, choice][-every:]
            if n % every == 0:
                out.append((key[0], n, recent.count("save_later"), recent.count("not_relevant")))
        held.update((n, "|".join(recent)))
        yield pd.DataFrame(out, columns=["user", "n_answers", "saved", "rejected"])

    return answers.groupBy("user").applyInPandasWithState(run, "user long, n_answers long, saved int, rejected int", "n long, recent string", "append", GroupStateTimeout.NoTimeout)


def rolling_rates(answers: DataFrame, days: int = V.LOOKBACK_DAYS, late: str = "1 day") -> DataFrame:
    """(day, user, n, saved, rejected, read) of the `days` days that end with `day`, once the watermark has passed it.

    Answers (user, ts, choice) are counted by day first and the days' counts by sliding windows, so an answer is copied into
    no more than one state row, and a user's windows are made from days. Answers that come up to `late` late count.
    """
    daily = answers.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user").agg(*feedback.choice_counts())
    sliding = F.window(F.window_time("w"), f"{days} days", "1 day").alias("rolling")
    out = daily.groupBy(sliding, "user").agg(*[F.sum(c).alias(c) for c in feedback.COUNTS])
    return out.select(F.to_date(F.col("rolling.end") - F.expr("INTERVAL 1 DAY")).alias("day"), "user", *feedback.COUNTS)
