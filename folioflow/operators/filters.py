"""Verdicts on documents: kinds that are no papers, scope tags, exclusion scores, date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions.dates import within_window
from folioflow.functions.text import contains_any


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _false(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _starts(x: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.lower(x).startswith(p)
    return _false(out)


def is_draft(filename, title) -> Column:
    return _false(_c(filename).rlike(V.DRAFT_FILE)) | contains_any(title, V.DRAFT_TITLE_TERMS)


def is_poster(filename, venue, title, source_type) -> Column:
    return _false(_c(filename).rlike(V.POSTER_FILE)) | contains_any(venue, ["poster"]) | _false(_c(title).rlike(V.POSTER_TITLE)) | _false(F.lower(_c(source_type)).isin(V.POSTER_TYPES))


def is_meeting_abstract(title, venue, source_type, doi) -> Column:
    title, doi = F.trim(_c(title)), F.lower(_c(doi))
    suffix = F.substring_index(doi, "/", -1)
    short = doi.startswith(V.ABSTRACT_DOI) & (F.size(F.split(doi, "/")) > 2) & (title != "") & (F.length(title) < V.ABSTRACT_TITLE_BELOW) & suffix.contains(".") & (F.length(suffix) <= V.ABSTRACT_SUFFIX_MOST)
    return _false(title.rlike(V.MEETING_TITLE)) | contains_any(venue, V.MEETING_VENUES) | _false(F.lower(_c(source_type)).isin(V.MEETING_TYPES)) | _false(short)


def is_preprint_doi(doi) -> Column:
    return _starts(_c(doi), V.PREPRINT_PREFIXES)


def is_review_doc(title, source_type) -> Column:
    """Titles decide; the type peer-review does without them."""
    return _false(_c(title).rlike(V.REVIEW_TITLE)) | _false(F.lower(_c(source_type)) == "peer-review")


def is_textbook(pages, title, doi) -> Column:
    book = _starts(_c(doi), V.BOOK_PREFIXES) & ~_starts(_c(doi), V.NO_BOOK_PREFIXES)
    return _false(_c(pages) >= V.TEXTBOOK_PAGES) | _false(_c(title).rlike(V.TEXTBOOK_TITLE)) | book


def scope_tags(text, venue=None, terms: dict[str, list[str]] = V.SCOPE_TERMS, venues: list[str] = V.SCOPE_VENUES) -> Column:
    """Tags in fixed order, each once; a known venue adds its own."""
    tags = [F.when(contains_any(text, words), tag) for tag, words in terms.items()]
    if venue is not None:
        tags.append(F.when(contains_any(venue, venues), V.VENUE_TAG))
    return F.array_compact(F.array(*tags))


def relevance(tags, source, curated: str = V.CURATED_SOURCE) -> Column:
    """Tagged, or from the curated source."""
    return (F.size(_c(tags)) > 0) | _false(_c(source) == curated)


def verdicts(df: DataFrame, terms: dict[str, list[str]] = V.SCOPE_TERMS, venues: list[str] = V.SCOPE_VENUES, carry_type: bool = True, curated: str = V.CURATED_SOURCE) -> DataFrame:
    """Adds the five flags, tags, relevance and reasons to (canonical_id, filename, title, abstract, venue, source, source_type, doi, page_count).

    carry_type=False ignores the source type, as callers without the payload do.
    """
    kind = F.col("source_type") if carry_type else F.lit(None).cast("string")
    out = df.withColumns({
        "is_draft": is_draft("filename", "title"),
        "is_poster": is_poster("filename", "venue", "title", kind),
        "is_textbook": is_textbook("page_count", "title", "doi"),
        "is_review_doc": is_review_doc("title", kind),
        "is_conf_abstract": is_meeting_abstract("title", "venue", kind, "doi"),
        "lab_scope_tags": scope_tags(F.concat_ws(" ", "title", "abstract"), "venue", terms, venues),
    })
    flags = ["is_draft", "is_poster", "is_textbook", "is_review_doc", "is_conf_abstract"]
    relevant = relevance("lab_scope_tags", "source", curated)
    none = ~(F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2]) | F.col(flags[3]) | F.col(flags[4]))
    why = F.when(F.col("page_count") >= V.TEXTBOOK_PAGES, F.concat(F.lit("page_count="), F.col("page_count"))).when(F.col("doi").isNotNull(), "book DOI prefix").otherwise("title keyword")
    reasons = F.create_map(
        F.lit("draft"), F.when(F.col("is_draft"), "file or title"),
        F.lit("poster"), F.when(F.col("is_poster"), "file, title, venue or type"),
        F.lit("textbook"), F.when(F.col("is_textbook"), why),
        F.lit("review_doc"), F.when(F.col("is_review_doc"), F.coalesce(kind, F.lit("title"))),
        F.lit("conf_abstract"), F.when(F.col("is_conf_abstract"), F.coalesce(kind, F.lit("title, venue or DOI"))),
        F.lit("lab_irrelevant"), F.when(~relevant, "no scope tag"),
    )
    return out.withColumn("is_lab_relevant", relevant & none).withColumn("filter_reason", F.map_filter(reasons, lambda k, v: v.isNotNull()))


def exclusion_score(title, abstract, wanted: list[str], unwanted: list[str]) -> Column:
    """Struct score, in_hits, hard_reason, verdict. The two term lists are parameters (see sources.read_terms)."""
    text = F.concat(F.lower(F.coalesce(_c(title), F.lit(""))), F.lit("\n"), F.lower(F.coalesce(_c(abstract), F.lit(""))))
    present = lambda terms: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t)))
    hard = F.coalesce(*[F.when(_false(_c(title).rlike(p)) | _false(_c(abstract).rlike(p)), reason) for p, reason in V.HARD_EXCLUSIONS])
    ins, outs = present(wanted), present(unwanted)
    score = F.when(hard.isNotNull(), -99).otherwise(ins - outs)
    template = (score <= -2) | ((score == -1) & (ins == 0))
    return F.struct(score.alias("score"), ins.alias("in_hits"), hard.alias("hard_reason"), F.when(template, "oos_template").otherwise("agent_fanout").alias("verdict"))


def oos_template_rows(classified: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template rows for excluded documents without a record, documents to keep in the queue)."""
    excluded = classified.where(F.col("verdict") == "oos_template")
    note = F.concat(F.coalesce("hard_reason", F.lit("out of scope")), F.lit("."))
    rows = excluded.join(existing.select("canonical_id"), "canonical_id", "left_anti").select("canonical_id", F.array().cast("array<string>").alias("frameworks"), F.lit(0.0).alias("coverage"), note.alias("out_of_scope_note"))
    return rows, classified.where(F.col("verdict") != "oos_template")


def abstract_gate(abstract) -> Column:
    return _false(F.length(F.trim(_c(abstract))) >= V.ABSTRACT_LEAST)


def tiered_windows(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows of (unit, query, date, is_preprint) within the strict window, plus relaxed ones for units whose strict hits are none over at least three queries."""
    strict = df.where(within_window(F.col("date"), F.col("is_preprint"), "strict", as_of)).withColumn("tier", F.lit("strict"))
    asked = df.groupBy("unit").agg(F.count_distinct("query").alias("n")).where("n >= 3").select("unit")
    open_units = asked.join(strict.select("unit").distinct(), "unit", "left_anti")
    relaxed = df.where(within_window(F.col("date"), F.col("is_preprint"), "relaxed", as_of)).join(open_units, "unit", "left_semi").withColumn("tier", F.lit("relaxed"))
    return strict.unionByName(relaxed)


def banned_terms(text, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.lower(_c(text)).contains(F.lower(t)))


def over_cap(text, words: tuple[str, ...] = ("paradigm", "framework"), most: int = 1) -> Column:
    return F.array_compact(F.array(*[F.when(F.regexp_count(F.lower(_c(text)), F.lit(w)) > most, F.lit(f"{w}>{most}")) for w in words]))


def classify_reply(text, cues=V.REPLY_CUES) -> Column:
    """The first signal, in order of precedence, one of whose cues the text holds."""
    return F.coalesce(*[F.when(contains_any(text, words), signal) for signal, words in cues], F.lit(V.NO_CUE))


def pick_alternate(text, alternates) -> Column:
    """The alternate that the first digit from 1 to 9 in the text names."""
    return F.try_element_at(_c(alternates), F.nullif(F.regexp_extract(_c(text), "([1-9])", 1), F.lit("")).cast("int"))


def free_text_choice(text, synonyms: dict[str, str]) -> Column:
    """Answer typed freely -> choice: a digit, an option's start or a synonym; null rather than a guess."""
    bare = F.lower(F.trim(F.regexp_replace(_c(text), r"[\s.)!]+$", "")))
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.coalesce(F.try_element_at(table, bare), F.try_element_at(table, F.regexp_extract(bare, r"^(\S+)", 1)))
