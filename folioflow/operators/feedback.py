"""Answers, drift, belief updates and what follows from replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions.text import pattern_tokens

STATUS = {"save_later": "saved", "already_read": "read", "not_relevant": "rejected", "skipped": "skipped"}


def latest(answers: DataFrame, by: list[str], at: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key by `at`; an aggregate, so it combines before the shuffle."""
    best = F.max_by(F.struct(*keep), F.struct(*at))
    return answers.groupBy(*by).agg(best.alias("r")).select(*by, "r.*")


def status(choice: str | Column) -> Column:
    c = F.col(choice) if isinstance(choice, str) else choice
    return F.coalesce(*[F.when(c == k, v) for k, v in STATUS.items()], c)


def status_pivot(answers: DataFrame, by: str = "user") -> DataFrame:
    return answers.groupBy(by).pivot("status", list(STATUS.values())).count().fillna(0)


def drift(answers: DataFrame, by: str, stale: DataFrame | None = None) -> DataFrame:
    """Precision, read rate and flags of each user's answers; users with few answers get no flag."""
    n = lambda c: F.count_if(F.col("choice") == c)
    saved, read, bad = n("save_later"), n("already_read"), n("not_relevant")
    out = answers.groupBy(by).agg(F.count("*").alias("n"), saved.alias("saved"), read.alias("read"), bad.alias("bad"))
    out = out.withColumn("precision", F.try_divide("saved", F.col("saved") + F.col("bad"))).withColumn("read_rate", F.try_divide("read", "n"))
    enough = F.col("n") >= V.DRIFT_LEAST
    flags = [F.when(enough & (F.col("precision") < V.DRIFT_PRECISION), "low_precision"), F.when(enough & (F.col("read_rate") > V.DRIFT_READ_RATE), "high_read_rate")]
    if stale is not None:
        out = out.join(stale.select(by, F.lit(True).alias("stale")), by, "left")
        flags.append(F.when(enough & F.col("stale"), "stale_fingerprint"))
    return out.withColumn("flags", F.array_compact(F.array(*flags))).drop("stale")


#: What rates are made of.
COUNTS = ["n", "saved", "rejected", "read"]


def choice_counts() -> list[Column]:
    """Aggregates over rows with a choice."""
    of = lambda c: F.count_if(F.col("choice") == c)
    return [F.count("*").alias("n"), of("save_later").alias("saved"), of("not_relevant").alias("rejected"), of("already_read").alias("read")]


def rates(df: DataFrame) -> DataFrame:
    """df, which has the COUNTS, with precision, read_rate and flags; few answers give no flag."""
    out = df.withColumn("precision", F.try_divide("saved", F.col("saved") + F.col("rejected"))).withColumn("read_rate", F.try_divide("read", "n"))
    enough = F.col("n") >= V.DRIFT_LEAST
    flags = [F.when(enough & (F.col("precision") < V.DRIFT_PRECISION), "low_precision"), F.when(enough & (F.col("read_rate") > V.DRIFT_READ_RATE), "high_read_rate")]
    return out.withColumn("flags", F.array_compact(F.array(*flags)))


def rolling_rates(answers: DataFrame, days: int = V.LOOKBACK_DAYS) -> DataFrame:
    """(user, day, COUNTS, precision, read_rate, flags) for each day on which a user answered: over the `days` days that end with it.

    answers: user, ts, choice. A user's answers are counted by day before the shuffle, so the frame, a range of days,
    goes over one row a day however many answers a user has. Answers without a time are left out; a null user is a user.
    """
    daily = answers.where("ts IS NOT NULL").groupBy("user", F.to_date("ts").alias("day")).agg(*choice_counts())
    w = Window.partitionBy("user").orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    return rates(daily.select("user", "day", *[F.sum(c).over(w).alias(c) for c in COUNTS]))


def lookback(answers: DataFrame, now: Column, days: int = V.LOOKBACK_DAYS) -> DataFrame:
    """(user, n_all, COUNTS, precision, read_rate, flags): all answers of a user, and those of the `days` days before `now`; one pass."""
    recent = (F.col("ts") >= now - F.make_dt_interval(F.lit(days))) & (F.col("ts") < now)
    marked = answers.withColumn("choice", F.when(recent, F.coalesce("choice", F.lit(""))))
    counted = marked.groupBy("user").agg(F.count("*").alias("n_all"), F.count("choice").alias("n"), *choice_counts()[1:])
    return rates(counted)


def breakdown(answers: DataFrame, by: str, dims: list[str]) -> DataFrame:
    """Counts of answers by choice and by each dimension and choice, in one pass: (by, dim, value, choice, n)."""
    each = F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d), F.lit("unknown")).alias("value")) for d in dims])
    return answers.select(by, "choice", F.explode(each).alias("d")).groupBy(by, "d.dim", "d.value", "choice").agg(F.count("*").alias("n"))


def review_windows(answers: DataFrame, by: str, at: list[str], every: int = V.REVIEW_EVERY) -> DataFrame:
    """Every tenth answer closes a window over the last ten: (by, n_answers, saved, rejected)."""
    w = Window.partitionBy(by).orderBy(*at)
    over = w.rowsBetween(-(every - 1), 0)
    n = lambda c: F.sum((F.col("choice") == c).cast("int")).over(over)
    numbered = answers.withColumns({"n_answers": F.row_number().over(w), "saved": n("save_later"), "rejected": n("not_relevant")})
    return numbered.where(F.col("n_answers") % every == 0).select(by, "n_answers", "saved", "rejected")


def last_rows(answers: DataFrame, by: str, at: list[Column], n: int = V.REVIEW_EVERY) -> DataFrame:
    return answers.withColumn("recency", F.row_number().over(Window.partitionBy(by).orderBy(*at))).where(F.col("recency") <= n)


def belief_update(prefs: DataFrame, tagged: DataFrame, by: str = "user") -> DataFrame:
    """(by, code, weight, new_weight): codes in three saves rise if they are low, in three rejects with two reasons they fall.

    tagged: by, code, choice, reason (of the answers under review); prefs: by, code, weight.
    """
    counts = tagged.groupBy(by, "code").agg(
        F.count_if(F.col("choice") == "save_later").alias("saves"),
        F.count_if(F.col("choice") == "not_relevant").alias("rejects"),
        F.count_if((F.col("choice") == "not_relevant") & F.coalesce("reason", F.lit(False))).alias("reasons"),
    )
    both = prefs.join(counts, [by, "code"], "left").fillna(0, ["saves", "rejects", "reasons"])
    w = F.col("weight")
    new = F.when((F.col("saves") >= 3) & (w <= 0.5), F.least(F.lit(1.0), w + 0.2)).when((F.col("rejects") >= 3) & (F.col("reasons") >= 2), F.greatest(F.lit(0.1), w - 0.3)).otherwise(w)
    return both.select(by, "code", "weight", new.alias("new_weight"))


def valid_update(updates: DataFrame, codes: DataFrame, by: str = "user") -> DataFrame:
    """Keeps the new weights of users whose update is sound as a whole; the others keep their old ones."""
    known = updates.join(F.broadcast(codes.select("code", F.lit(True).alias("known"))), "code", "left")
    ok = known.groupBy(by).agg(F.bool_and(F.col("new_weight").between(0, 1) & F.coalesce("known", F.lit(False))).alias("ok"))
    return updates.join(ok, by).select(by, "code", F.when(F.col("ok"), F.col("new_weight")).otherwise(F.col("weight")).alias("weight"))


def silence(cycles: DataFrame) -> DataFrame:
    """(member, cycle, silent_before, streak2): no replies in this cycle and in the one before."""
    w = Window.partitionBy("member").orderBy("cycle")
    before = F.lag("replies").over(w)
    return cycles.withColumn("before", before).withColumn("streak2", F.coalesce((F.col("replies") == 0) & (F.col("before") == 0), F.lit(False)))


def token_patterns(events: DataFrame, tokens: Column, by: str, at: list[Column], recent: int = 200, least: int = 2) -> DataFrame:
    """Tokens that occur at least twice in the most recent messages."""
    last = events.withColumn("_n", F.row_number().over(Window.orderBy(*at))) if by is None else events.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*at)))
    return last.where(F.col("_n") <= recent).select(*([by] if by else []), F.explode(tokens).alias("token")).groupBy(*([by] if by else []), "token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# --- fixed values: the latest events that an evolution pass looks at, and how often a word makes a pattern ----
EVOLUTION_EVENTS, PATTERN_LEAST = 200, 2
SILENT = ["timeout", "no_rec"]


def evolution(events: DataFrame, cycles: DataFrame, cycle: str) -> DataFrame:
    """(change_type, unit_id, detail_json, source): what an evolution pass over a cycle logs. It only logs: no rule changes by it.

    events: event_id, occurred_at, signal, member, unit_id, doi, text, of which the latest EVOLUTION_EVENTS count; cycles: cycle_id,
    member, unit_id, state, doi, reply_count. Logged are the latest exclusions that belong to the cycle, words that several
    of the latest refusals share, and units silent in this cycle and in the member's one before.
    """
    last = events.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(EVOLUTION_EVENTS)
    now = cycles.where(F.col("cycle_id") == cycle)
    barred = last.where(F.col("signal").isin("thumbs_down", "already_read")).join(now.select("member", "doi"), ["member", "doi"], "left_semi")
    kind = F.when(F.col("signal") == "already_read", "read_doi").otherwise("exclusion_keyword")
    first = barred.select(kind.alias("change_type"), F.coalesce("unit_id", F.lit("")).alias("unit_id"), F.to_json(F.struct("doi", "signal", "member")).alias("detail_json"), F.lit("feedback").alias("source"))
    words = last.where("signal = 'thumbs_down'").select(F.explode(pattern_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("count")).where(F.col("count") >= PATTERN_LEAST)
    second = words.select(F.lit("query_seed_drop").alias("change_type"), F.lit("").alias("unit_id"), F.to_json(F.struct("token", "count")).alias("detail_json"), F.lit("feedback:pattern").alias("source"))
    before = cycles.where(F.col("cycle_id") < cycle).groupBy("member").agg(F.max_by(F.coalesce("reply_count", F.lit(0)), "cycle_id").alias("_before"))
    quiet = now.where((F.coalesce("reply_count", F.lit(0)) == 0) & F.col("state").isin(SILENT)).join(before.where("_before = 0"), "member")
    third = quiet.select(F.lit("criteria").alias("change_type"), F.coalesce("unit_id", F.lit("")).alias("unit_id"), F.to_json(F.struct(F.lit("silence_streak_2").alias("flag"), "member")).alias("detail_json"), F.lit("silence_pattern").alias("source"))
    return first.unionByName(second).unionByName(third)


def non_repliers(drafts: DataFrame, replies: DataFrame, by: str = "member") -> DataFrame:
    return drafts.join(replies.select(by).distinct(), by, "left_anti")


def never_recommend(sent: DataFrame, read: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(unit, doi_set, title_terms): everything a unit must not get again; exclusion terms are DOIs or keywords."""
    from folioflow.functions.text import doi_normalize, is_doi_like

    dois = sent.select("unit", "doi").unionByName(read.select("unit", "doi")).unionByName(exclusions.where(is_doi_like("term")).select("unit", F.col("term").alias("doi")))
    words = exclusions.where(~is_doi_like("term")).select("unit", F.col("term").alias("word"))
    a = dois.groupBy("unit").agg(F.sort_array(F.collect_set(doi_normalize("doi"))).alias("dois"))
    b = words.groupBy("unit").agg(F.sort_array(F.collect_set(F.lower("word"))).alias("words"))
    none = F.array().cast("array<string>")
    return a.join(b, "unit", "full").select("unit", F.coalesce("dois", none).alias("dois"), F.coalesce("words", none).alias("words"))
