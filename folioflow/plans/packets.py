"""Packets, proposals and JSON rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions.json_values import json_has, json_merged, json_size, like_any
from folioflow.operators import packet
from folioflow.plans.base import PAPERS, papers, table
from folioflow.sources import readers


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """A draft a document, its text the document's; some lack fields, some the link."""
    p = papers(spark, d).where("doc_id % 9 <> 4")
    return p.select(
        F.concat(F.lit("u"), "doc_id").alias("unit_id"), F.array("source").alias("channel_ids"), F.array("lang").alias("dm_inits"), F.col("text").alias("channel_text"),
        F.concat_ws(" ", "title", F.when(F.col("n_chars") % 2 == 0, packet.LINK)).alias("dm_ping_text"), F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), F.lit("")).alias("paper_doi"),
        F.col("title").alias("paper_title"), F.col("year").cast("string").alias("paper_date"), F.when(F.col("is_preprint"), "relaxed").otherwise("strict").alias("tier"),
    )


def draft_problems(spark: SparkSession, d: str) -> DataFrame:
    """Documents as units; the best candidate of every seventh is another one's DOI."""
    p = papers(spark, d)
    units = p.select(F.concat(F.lit("u"), "doc_id").alias("unit_id"))
    tops = p.select(F.concat(F.lit("u"), "doc_id").alias("unit_id"), F.when(F.col("doc_id") % 7 == 0, "10.9999/other").otherwise(F.col("doi")).alias("doi"))
    return packet.draft_problems(units, _drafts(spark, d), tops)


DRAFT_PROBLEMS = f"""WITH {PAPERS}, t AS (SELECT *, 'u' || doc_id AS unit_id, doc_id % 9 <> 4 AS there FROM papers)
SELECT unit_id, 'no draft' AS problem FROM t WHERE NOT there UNION ALL SELECT unit_id, 'missing channel_text' FROM t WHERE there AND coalesce(text, '') = ''
UNION ALL SELECT unit_id, 'missing dm_ping_text' FROM t WHERE there AND title = '' AND n_chars % 2 <> 0 UNION ALL SELECT unit_id, 'missing paper_doi' FROM t WHERE there AND doi IS NULL
UNION ALL SELECT unit_id, 'missing paper_title' FROM t WHERE there AND title = '' UNION ALL SELECT unit_id, 'no link in dm_ping_text' FROM t WHERE there AND n_chars % 2 <> 0
UNION ALL SELECT unit_id, 'paper_doi is not the best candidate''s' FROM t WHERE there AND doi IS NOT NULL AND doc_id % 7 = 0"""


def feedback_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Turns of users as replies to the drafts of their conversations, which name other turns as alternates."""
    t = table(spark, d, "conversations")
    replies = t.where("role = 'user'").select(F.col("conv_id").cast("string").alias("member"), F.col("turn").alias("ts"), F.concat_ws(" ", "text", F.when(F.col("turn") % 3 == 0, F.lit("2 thanks")).when(F.col("turn") % 4 == 2, F.lit("already read"))).alias("text"))
    drafts = t.where("conv_id % 5 <> 0").groupBy(F.col("conv_id").cast("string").alias("member")).agg(F.array_sort(F.collect_set(F.concat(F.lit("10.1/"), "turn"))).alias("alternates"))
    drafts = drafts.select("member", F.concat(F.lit("c"), "member").alias("unit_id"), F.concat(F.lit("10.2/"), "member").alias("paper_doi"), "alternates")
    out = packet.feedback_proposals(replies, drafts, "run")
    return out.select("member", "unit_id", "signal", "confidence", F.md5("reply_text").alias("md5"), "reply_ts", "idem_key", "excluded_term", "exclusion_reason", "picked_alternate_doi", F.length(F.get_json_object("payload_json", "$.text")).alias("n"))


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{x}')" for x in terms) + ")"


_SIGNAL = "CASE " + " ".join(f"WHEN {_any([w.lower() for w in words])} THEN '{s}'" for s, words in V.REPLY_CUES) + f" ELSE '{V.NO_CUE}' END"
FEEDBACK_PROPOSALS = f"""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS member, turn AS ts, concat_ws(' ', text, CASE WHEN turn % 3 = 0 THEN '2 thanks' WHEN turn % 4 = 2 THEN 'already read' END) AS t FROM conversations WHERE role = 'user'),
d AS (SELECT CAST(conv_id AS VARCHAR) AS member, list_sort(list(DISTINCT '10.1/' || turn)) AS alts FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1),
s AS (SELECT r.member, ts, substr(t, 1, 500) AS short, alts, {_SIGNAL} AS signal, regexp_extract(t, '[1-9]') AS digit FROM r LEFT JOIN d USING (member))
SELECT member, CASE WHEN alts IS NULL THEN member ELSE 'c' || member END AS unit_id, signal, CASE WHEN signal = 'thread_reply' THEN 'low' ELSE 'high' END AS confidence, md5(short) AS md5, ts AS reply_ts, 'run:' || member || ':' || ts AS idem_key,
  CASE WHEN signal IN ('thumbs_down', 'already_read') THEN CASE WHEN alts IS NULL THEN '' ELSE '10.2/' || member END END AS excluded_term, CASE WHEN signal IN ('thumbs_down', 'already_read') THEN 'feedback:' || signal END AS exclusion_reason,
  CASE WHEN digit <> '' THEN alts[CAST(digit AS INTEGER)] END AS picked_alternate_doi, CAST(length(short) AS INTEGER) AS n FROM s"""


def review_packet(spark: SparkSession, d: str) -> DataFrame:
    """Brands as units, their forty dearest parts as the search's candidates: the lines of all pages."""
    p = table(spark, d, "part")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    c = p.select(F.col("p_brand").alias("unit_id"), place.alias("position"), F.concat(F.lit("10.1/"), "p_partkey").alias("doi"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.lit("2024").alias("date"), F.col("p_retailprice").alias("composite"), F.lit("D1").alias("best_dim"), F.lit("strict").alias("tier"), F.col("p_type").alias("grounding")).where("position <= 40")
    units = c.where("position = 1").select("unit_id", "doi")
    drafts = units.where("unit_id NOT LIKE '%5'").select("unit_id", F.concat(F.lit("On "), "doi").alias("channel_text"), F.lit(packet.LINK).alias("dm_ping_text"))
    return packet.packet_lines("r1", units, c, drafts)


REVIEW_PACKET = """WITH c AS (SELECT p_brand AS u, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos, '10.1/' || p_partkey AS doi, p_name AS title, p_retailprice AS comp, p_type AS g FROM part QUALIFY pos <= 40),
k AS (SELECT u, doi, title, comp, CAST(count(*) OVER (PARTITION BY u) AS VARCHAR) AS n, pos FROM c WHERE u NOT LIKE '%5'),
t AS (SELECT * FROM k WHERE pos = 1),
b AS (SELECT c.u, c.pos, '- **#' || c.pos || '** ' || c.comp || ' (D1) [strict]' || CASE WHEN c.pos = 1 THEN ' (chosen)' ELSE '' END || ' ' || c.title AS l1, '  ' || c.u || ' · 2024 · ' || c.doi AS l2, '  ' || substr(g, 1, 200) AS l3 FROM c JOIN t USING (u)),
page AS (SELECT u, list_concat(['# ' || u, '', 'Chosen: **' || title || '**', 'DOI: ' || doi, '', '### channel_text', '```', 'On ' || doi, '```', '', '### dm_ping_text', '```', '{permalink}', '```', '', '## Candidates: ' || n, ''], (SELECT flatten(list([l1, l2, l3] ORDER BY b.pos)) FROM b WHERE b.u = t.u)) AS ls FROM t),
idx AS (SELECT u, list_concat(['## ' || u], (SELECT flatten(list([l1, l2] ORDER BY b.pos)) FROM b WHERE b.u = t.u), ['']) AS ls FROM t),
heads AS (SELECT * FROM (VALUES ('README.md', '', 0, '# Run r1: review packet'), ('README.md', '', 1, ''), ('README.md', '', 2, '| unit | chosen | composite | dimension | candidates |'), ('README.md', '', 3, '|---|---|---|---|---|'), ('candidates.md', '', 4, '# r1: all candidates'), ('candidates.md', '', 5, '')) v(file, unit, line, text))
SELECT * FROM heads UNION ALL SELECT replace(u, '+', '_') || '.md', u, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER), unnest(ls) FROM page
UNION ALL SELECT 'candidates.md', u, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER), unnest(ls) FROM idx
UNION ALL SELECT 'README.md', u, 0, '| ' || u || ' | ' || CASE WHEN length(title) > 52 THEN substr(title, 1, 52) || '…' ELSE title END || ' | ' || comp || ' | D1 | ' || n || ' |' FROM t"""


def json_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Properties of one kind of events get a marker, unless they have one; the others stay."""
    e = table(spark, d, "events")
    given = F.when(F.col("event_id") % 3 == 0, json_merged("props", F.to_json(F.struct(F.lit("old").alias("_from"))))).otherwise(F.col("props"))
    mark = F.to_json(F.struct(F.col("event_type").alias("_from"), F.col("value").alias("k")))
    new = F.when(like_any("event_type", "VIEW%", "%ror"), F.when(json_has(given, "_from"), given).otherwise(json_merged(given, mark))).otherwise(given)
    return e.select("event_id", F.get_json_object(new, "$._from").alias("marker"), F.get_json_object(new, "$.k").cast("double").alias("k"), json_size(F.to_json(F.array("event_type", F.col("user_id").cast("string")))).alias("n"))


JSON_REWRITE = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'old' WHEN event_type IN ('view', 'error') THEN event_type END AS marker,
CASE WHEN event_id % 3 <> 0 AND event_type IN ('view', 'error') THEN value ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, 2 AS n FROM events"""

def work_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as works in JSON, their lines as authors, some of them ghosts; DOIs of orders that are no work give stubs."""
    k = F.col("l_orderkey")
    author = F.struct((F.col("l_returnflag") == "R").alias("is_corresponding"), F.when(F.col("l_linenumber") % 4 != 3, F.struct(F.concat(F.lit("https://a/"), F.col("l_suppkey")).alias("id"), F.when(F.col("l_linenumber") % 4 != 2, F.concat(F.lit("S"), F.col("l_suppkey"))).alias("display_name"))).alias("author"))
    lines = table(spark, d, "lineitem").groupBy(k.alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", author.alias("a")))), lambda x: x["a"]).alias("authorships"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    place = F.struct(F.struct(F.col("o_orderpriority").alias("display_name"), F.when(F.col("o_orderstatus") == "P", "Repository").alias("type")).alias("source"))
    work = F.struct(F.concat(F.lit("W"), "o_orderkey").alias("id"), F.concat(F.lit(" Order "), "o_orderkey").alias("title"), F.concat(F.lit("https://doi.org/10.1/O"), "o_orderkey").alias("doi"), F.lit("article").alias("type"), F.date_format("o_orderdate", "yyyy").alias("publication_year"), F.when(F.col("o_orderstatus") != "F", place).alias("primary_location"), "authorships")
    works = o.where("o_orderkey % 6 <> 0").select(F.from_json(F.to_json(work), readers.WORK).alias("w")).select("w.*")
    dois = o.select(F.concat(F.lit("10.1/o"), "o_orderkey").alias("doi"))
    out = readers.looked_up_papers(dois, works, F.lit("2024-01-01").cast("timestamp"))
    return out.select("canonical_id", "doi", "title", "title_norm", F.array_join("authors", ",").alias("authors"), "venue", "year", "is_preprint", F.col("source_payload.work_id").alias("work_id"))


WORK_RECORDS = """WITH a AS (SELECT l_orderkey AS k, string_agg('S' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber % 4 NOT IN (2, 3)) AS authors FROM lineitem GROUP BY 1)
SELECT substr(sha256('doi:10.1/o' || o_orderkey), 1, 32) AS canonical_id, '10.1/o' || o_orderkey AS doi, CASE WHEN w THEN 'Order ' || o_orderkey END AS title, CASE WHEN w THEN 'order' || o_orderkey ELSE '' END AS title_norm, CASE WHEN w THEN coalesce(authors, '') ELSE '' END AS authors,
  CASE WHEN w AND o_orderstatus <> 'F' THEN o_orderpriority END AS venue, CASE WHEN w THEN CAST(year(o_orderdate) AS INTEGER) END AS year, w AND o_orderstatus = 'P' AS is_preprint, CASE WHEN w THEN 'W' || o_orderkey END AS work_id
FROM (SELECT *, o_orderkey % 6 <> 0 AS w FROM orders) LEFT JOIN a ON k = o_orderkey"""

QUERIES = {f.__name__: f for f in (draft_problems, feedback_proposals, review_packet, work_records, json_rewrite)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
