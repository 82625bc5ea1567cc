"""Drafts of messages and what must not be in them. Nothing is sent: a draft is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.dates import within_window
from folioflow.functions.text import doi_normalize, matching_blocks, title_clean
from folioflow.operators.filters import banned_terms
from folioflow.operators.similar import similar_pairs
from folioflow.sources.scratch import written

#: Composite from which a candidate may be an alternate, and how many a draft names.
ALTERNATE_LEAST, ALTERNATE_MOST = 5, 6


def alternates(recs: DataFrame, candidates: DataFrame, excluded: DataFrame, least: float = ALTERNATE_LEAST, most: int = ALTERNATE_MOST) -> DataFrame:
    """(unit, doi, title, place): the unit's best other candidates. recs, excluded: unit, doi; candidates: unit, doi, title, composite."""
    barred = recs.select("unit", "doi").unionByName(excluded.select("unit", "doi"))
    open_ = candidates.where(F.col("composite") >= least).join(barred, ["unit", "doi"], "left_anti")
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("composite"), "doi"))
    return open_.withColumn("place", place).where(F.col("place") <= most)


def assemble(recs: DataFrame, alts: DataFrame) -> DataFrame:
    """(unit, doi, alternates, body): one draft a recommendation; alternates are numbered in their order."""
    line = F.format_string("%d. %s · https://doi.org/%s", F.col("place"), F.coalesce("title", F.lit("-")), F.col("doi"))
    lists = alts.select("unit", F.struct("place", "doi", line.alias("line")).alias("a")).groupBy("unit").agg(F.array_sort(F.collect_list("a")).alias("a"))
    head = F.format_string("%s\nhttps://doi.org/%s", F.coalesce("title", F.lit("-")), F.col("doi"))
    lines = F.coalesce(F.transform("a", lambda x: x["line"]), F.array().cast("array<string>"))
    dois = F.coalesce(F.transform("a", lambda x: x["doi"]), F.array().cast("array<string>"))
    return recs.join(lists, "unit", "left").select("unit", "doi", "title", dois.alias("alternates"), F.array_join(F.concat(F.array(head), lines), "\n").alias("body"))


def followups(drafts: DataFrame, replies: DataFrame, banned: list[str]) -> DataFrame:
    """Drafts of units that did not reply, with a reminder as body; one whose text holds a banned term is left out."""
    body = F.format_string("Did you see \"%s\" (https://doi.org/%s)?", F.coalesce("title", F.lit("-")), F.col("doi"))
    return drafts.join(replies.select("unit"), "unit", "left_anti").withColumn("body", body).where(F.size(banned_terms("body", banned)) == 0)


def acknowledgements(replies: DataFrame, drafts: DataFrame, actions: dict[str, str], other: str, banned: list[str]) -> DataFrame:
    """(unit, signal, doi, body) of every reply, also of a unit without draft: the action by signal, the picked alternate, the excluded term.

    replies: unit, signal, picked, excluded.
    """
    action = F.coalesce(*[F.when(F.col("signal") == k, F.lit(v)) for k, v in actions.items()], F.lit(other))
    extra = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.format_string(t, F.col(c))) for c, t in (("picked", "Next: %s."), ("excluded", "Excluded: %s."))]
    met = replies.join(drafts.select("unit", "doi", "title"), "unit", "left")
    body = F.concat_ws(" ", F.format_string("\"%s\":", F.coalesce("title", F.lit("-"))), action, *extra)
    return met.select("unit", "signal", F.coalesce("doi", F.lit("")).alias("doi"), body.alias("body")).where(F.size(banned_terms("body", banned)) == 0)


def preview(drafts: DataFrame, required: list[str], banned: list[str]) -> DataFrame:
    """drafts with n_chars (white space apart), banned and missing: what a dry run shows."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required]))
    return drafts.withColumns({"n_chars": F.length(F.regexp_replace("body", r"\s", "")), "banned": banned_terms("body", banned), "missing": missing})


def barred(candidates: DataFrame, dois: DataFrame, titles: DataFrame, least: float = 0.9) -> DataFrame:
    """(unit, doi, why): candidates of a unit that it must not get: a DOI in `dois` (unit, doi) or a title like one of `titles` (unit, title).

    Titles are compared within a unit only where the lossless fuzzy blocks let them meet.
    """
    norm = candidates.withColumn("_doi", doi_normalize("doi"))
    by_doi = norm.join(dois.select("unit", doi_normalize("doi").alias("_doi")).distinct(), ["unit", "_doi"], "left_semi").select("unit", "doi", F.lit("doi").alias("why"))
    # Titles are compared once each in a unit, however many candidates have them. Blanks that title_clean made of other white space go, too.
    clean = F.trim(title_clean("title")).alias("title_norm")
    titled = candidates.withColumn("title_norm", clean)
    # A short number names a title, as every block that the title is in gets the name as well.
    keyed = lambda df: written(df.select("unit", "title_norm").distinct().withColumn("canonical_id", F.monotonically_increasing_id()), "title-keys")
    a, b = keyed(titled), keyed(titles.select("unit", clean))
    # Matching blocks are a common subsequence, so the indel ratio is never below their ratio.
    met = similar_pairs(a, b, least, ["unit"], lambda x, y: x == y or matching_blocks(x, y) >= least)
    like = a.join(met.select(F.col("a").alias("canonical_id")).distinct(), "canonical_id", "left_semi").select("unit", "title_norm")
    by_title = titled.join(like, ["unit", "title_norm"], "left_semi").select("unit", "doi", F.lit("title").alias("why"))
    return by_doi.unionByName(by_title).groupBy("unit", "doi").agg(F.min("why").alias("why"))


def carry_over(pool: DataFrame, as_of: Column, excluded: DataFrame, tier: str = "strict") -> DataFrame:
    """Rows of the last run's pool that are still young enough and that no excluded term of the unit stands in, as DOI or in the title."""
    young = pool.where(within_window(F.col("date"), F.col("is_preprint"), tier, as_of))
    terms = excluded.groupBy("unit").agg(F.collect_set(F.lower("term")).alias("_terms"))
    hit = F.exists("_terms", lambda t: F.lower("title").contains(t) | (F.lower("doi") == t))
    return young.join(terms, "unit", "left").where(~F.coalesce(hit, F.lit(False))).drop("_terms")
