"""Dates, age bands and cycles. Every function takes the point in time it refers to; none asks the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import CHUNKS, WINDOWS


def flexible_date(x) -> Column:
    """YYYY-MM-DD, YYYY-MM or YYYY; null if none fits."""
    x = F.trim(F.col(x) if isinstance(x, str) else x)
    return F.coalesce(F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"), F.try_to_date(x, "yyyy-MM"), F.try_to_date(x, "yyyy"))


def age_chunk(year, pub_date, as_of_year: int) -> Column:
    """recent, mid or classic by age in years; a future year counts as new, a missing one as old."""
    year = F.col(year) if isinstance(year, str) else year
    known = F.coalesce(F.nullif(year, F.lit(0)), F.regexp_extract(pub_date, r"^(\d{4})", 1).try_cast("int"))
    age = F.when(known.isNotNull(), F.greatest(F.lit(0), F.lit(as_of_year) - known))  # greatest() skips nulls
    out = F.lit("classic")
    for name, low, high in reversed(CHUNKS):
        out = F.when((age >= low) & (age < high), name).otherwise(out)
    return out


def within_window(date: Column, is_preprint: Column, tier: str, as_of: Column) -> Column:
    """Not in the future and young enough for the tier and the kind of document."""
    journal, preprint = WINDOWS[tier]
    age = F.date_diff(as_of, date)
    return F.coalesce(age.between(0, F.when(is_preprint, preprint).otherwise(journal)), F.lit(False))


def cycle_start(ts: Column) -> Column:
    """Start of the weekly cycle: Friday 14:00 in Seoul, which is Friday 05:00 UTC."""
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    week, shift = 7 * 86400, 86400 + 5 * 3600  # the epoch was a Thursday
    return F.timestamp_seconds(F.floor((seconds - shift) / week) * week + shift)


def cycle_id(ts: Column) -> Column:
    return F.date_format(cycle_start(ts) + F.expr("INTERVAL 9 HOURS"), "yyyyMMdd-HHmm")


def seoul_text(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "Asia/Seoul"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def not_before(date, is_preprint, journal: str, preprint: str) -> Column:
    """Whether a date text is not before the cut of its kind, compared as text; no date is too old."""
    date, pre = (F.col(x) if isinstance(x, str) else x for x in (date, is_preprint))
    return F.coalesce((date != "") & (date >= F.when(pre, F.lit(preprint)).otherwise(F.lit(journal))), F.lit(False))


def hours_left(deadline: Column, as_of: Column) -> Column:
    """Hours until the deadline; negative once it has passed."""
    return (F.unix_timestamp(deadline) - F.unix_timestamp(as_of)) / 3600


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days from ts to as_of, rounded down."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400)
