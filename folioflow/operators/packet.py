"""From drafts and replies to what a person reviews: contract checks, feedback proposals, pages of a packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import unit_file
from folioflow.operators.filters import classify_reply, pick_alternate

# --- fixed values: fields of a draft, the place of the link, lengths, and signals that exclude ---------
REQUIRED = ["unit_id", "channel_ids", "dm_inits", "channel_text", "dm_ping_text", "paper_doi", "paper_title", "paper_date", "tier"]
LINK = "{permalink}"
REPLY_CHARS, GROUNDING_CHARS, TITLE_CHARS = 500, 200, 52
EXCLUDING = ["thumbs_down", "already_read"]
#: What is taken off the start of a DOI before it is compared: characters, not a prefix, so the DOI's own first ones may go too.
DOI_STRIP = "https://doi.org/"


def _blank(c: str, kind: str) -> Column:
    x = F.col(c)
    return x.isNull() | ((F.size(x) == 0) if kind.startswith("array") else (x.cast("string") == ""))


def draft_problems(units: DataFrame, drafts: DataFrame, tops: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """(unit_id, problem): what keeps a packet from being sent; one row a problem.

    units: unit_id; drafts: unit_id and the required fields; tops: unit_id and doi of the best candidate. A DOI that
    either side lacks is not compared. Of several drafts or tops of a unit each is looked at.
    """
    kinds = dict(drafts.dtypes)
    # The unit's own id is read off the key; here it says whether there is a draft at all.
    met = units.select("unit_id").distinct().join(drafts.withColumn("_there", F.lit(True)), "unit_id", "left").join(tops.select("unit_id", F.lower("doi").alias("_top")).distinct(), "unit_id", "left")
    there = F.coalesce("_there", F.lit(False))
    missing = [F.when(there & _blank(c, kinds[c]), F.lit(f"missing {c}")) for c in required if c != "unit_id"]
    link = F.when(there & ~F.coalesce(F.col("dm_ping_text").contains(LINK), F.lit(False)), "no link in dm_ping_text")
    bare = F.ltrim(F.lower("paper_doi"), F.lit("".join(dict.fromkeys(DOI_STRIP))))
    other = (F.col("paper_doi") != "") & (F.col("_top") != "") & ~F.col("_top").contains(bare) & ~F.col("paper_doi").contains(F.col("_top"))
    problems = F.array_compact(F.array(F.when(~there, "no draft"), *missing, link, F.when(there & F.coalesce(other, F.lit(False)), "paper_doi is not the best candidate's")))
    return met.select("unit_id", F.explode(problems).alias("problem"))


def feedback_proposals(replies: DataFrame, drafts: DataFrame, run_id: str) -> DataFrame:
    """What each reply (member, ts, text) should change, as rows to be confirmed.

    drafts: member, unit_id, paper_doi, alternates. A reply whose member has no draft keeps its own name as unit; of several
    drafts of a member the one with the largest DOI counts. An exclusion is proposed only for signals that a cue gave.
    """
    one = drafts.groupBy("member").agg(F.max_by(F.struct("unit_id", "paper_doi", "alternates"), F.struct("paper_doi", "unit_id")).alias("d"))
    met = replies.join(one, "member", "left")
    signal = classify_reply(F.coalesce("text", F.lit("")))
    out = met.withColumn("signal", signal).withColumn("confidence", F.when(F.col("signal") == "thread_reply", "low").otherwise("high"))
    doi, short = F.coalesce("d.paper_doi", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, REPLY_CHARS)
    out_of = F.col("signal").isin(EXCLUDING) & (F.col("confidence") == "high")
    return out.select(
        "member", F.coalesce("d.unit_id", "member").alias("unit_id"), "signal", "confidence", short.alias("reply_text"), F.col("ts").alias("reply_ts"), doi.alias("recommendation_doi"),
        F.to_json(F.struct(F.col("ts").alias("reply_ts"), short.alias("text"))).alias("payload_json"), F.concat_ws(":", F.lit(run_id), "member", F.col("ts").cast("string")).alias("idem_key"),
        F.when(out_of, doi).alias("excluded_term"), F.when(out_of, F.concat(F.lit("feedback:"), "signal")).alias("exclusion_reason"), pick_alternate("text", "d.alternates").alias("picked_alternate_doi"),
    )


def _cell(c: str, default: str = "-") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default))


def packet_lines(run_id: str, units: DataFrame, candidates: DataFrame, drafts: DataFrame) -> DataFrame:
    """(file, unit, line, text): the pages of a review packet, a page a unit, an index of candidates and a summary.

    units: unit_id, doi of the chosen candidate; candidates: unit_id, position, doi, title, venue, date, composite, best_dim, tier,
    grounding; drafts: unit_id, channel_text, dm_ping_text. Units without a draft are left out, as they cannot be reviewed. Lines of a
    file are ordered by unit, then line.
    """
    d = drafts.groupBy("unit_id").agg(F.max_by(F.struct("channel_text", "dm_ping_text"), F.struct("channel_text", "dm_ping_text")).alias("d"))
    chosen = units.groupBy("unit_id").agg(F.max("doi").alias("chosen")).join(d, "unit_id")
    fields = F.struct("position", "doi", "title", "venue", "date", "composite", "best_dim", "tier", "grounding")
    # A unit's candidates are few by contract of the search, which caps them.
    listed = candidates.groupBy("unit_id").agg(F.array_sort(F.collect_list(fields)).alias("all"))
    each = chosen.join(listed, "unit_id", "left").withColumn("all", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)))
    top = F.get(F.filter("all", lambda c: c["doi"] == F.col("chosen")), F.lit(0))
    each = each.withColumn("top", top).withColumn("_name", F.coalesce(F.col("top.title"), F.lit("-")))
    short = F.when(F.length("_name") > TITLE_CHARS, F.concat(F.substring("_name", 1, TITLE_CHARS), F.lit("…"))).otherwise(F.col("_name"))
    n = F.size("all").cast("string")

    def bullet(c: Column, more: bool) -> Column:
        val = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
        mark = F.when(c["doi"] == F.col("chosen"), " (chosen)").otherwise("")
        lines = [F.concat(F.lit("- **#"), val(c["position"]), F.lit("** "), val(c["composite"]), F.lit(" ("), val(c["best_dim"]), F.lit(") ["), val(c["tier"]), F.lit("]"), mark, F.lit(" "), val(c["title"])), F.concat(F.lit("  "), F.concat_ws(" · ", c["venue"], c["date"].cast("string"), c["doi"]))]
        return F.array(*lines, *([F.concat(F.lit("  "), F.substring(F.coalesce(c["grounding"], F.lit("")), 1, GROUNDING_CHARS))] if more else []))

    bullets = lambda more: F.flatten(F.transform("all", lambda c: bullet(c, more)))
    heads = [F.concat(F.lit("# "), F.col("unit_id")), F.lit(""), F.concat(F.lit("Chosen: **"), F.col("_name"), F.lit("**")), F.concat(F.lit("DOI: "), _cell("chosen")), F.lit("")]
    block = lambda title, c: [F.lit(f"### {title}"), F.lit("```"), F.coalesce(F.col(c), F.lit("")), F.lit("```"), F.lit("")]
    page = F.concat(F.array(*heads, *block("channel_text", "d.channel_text"), *block("dm_ping_text", "d.dm_ping_text"), F.concat(F.lit("## Candidates: "), n), F.lit("")), bullets(True))
    index = F.concat(F.array(F.concat(F.lit("## "), F.col("unit_id"))), bullets(False), F.array(F.lit("")))
    row = F.array(F.concat(F.lit("| "), F.concat_ws(" | ", "unit_id", short, _cell("top.composite"), _cell("top.best_dim"), n), F.lit(" |")))
    files = F.array(F.struct(F.concat(unit_file("unit_id"), F.lit(".md")).alias("file"), page.alias("lines")), F.struct(F.lit("candidates.md").alias("file"), index.alias("lines")), F.struct(F.lit("README.md").alias("file"), row.alias("lines")))
    pages = each.select("unit_id", F.explode(files).alias("f")).select("f.file", F.col("unit_id").alias("unit"), F.posexplode("f.lines").alias("line", "text"))
    title = [("README.md", f"# Run {run_id}: review packet"), ("README.md", ""), ("README.md", "| unit | chosen | composite | dimension | candidates |"), ("README.md", "|---|---|---|---|---|"), ("candidates.md", f"# {run_id}: all candidates"), ("candidates.md", "")]
    first = pages.sparkSession.createDataFrame([(f, "", i, t) for i, (f, t) in enumerate(title)], "file string, unit string, line int, text string")
    return first.unionByName(pages)


def write_packet(lines: DataFrame, path: str) -> None:
    """One folder a file, its lines in order; files are written in parallel, the lines of one file by one task."""
    lines.repartition("file").sortWithinPartitions("file", "unit", "line").select("file", "text").write.mode("overwrite").partitionBy("file").text(path)
