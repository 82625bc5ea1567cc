"""Feedback, ledger, conversation, merge and quality queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dates as D
from folioflow.functions import text as X
from folioflow.operators import dq, feedback, filters, merge, resolve
from folioflow.plans.base import ANSWERS, PAPERS, STOP, answers, papers, table
from folioflow.streaming import streams

BANNED = ["idiot", "moron", "stupid", "thank"]
AS_OF = datetime(2024, 2, 10)


def response_latest(spark: SparkSession, d: str) -> DataFrame:
    return feedback.latest(answers(spark, d), ["user", "item"], ["ts", "event_id"], ["choice", "event_id"])


LATEST = f"""{ANSWERS}, latest AS (SELECT "user", item, arg_max(choice, (ts, event_id)) AS choice, arg_max(event_id, (ts, event_id)) AS event_id FROM answers GROUP BY ALL)"""
RESPONSE_LATEST = f'WITH {LATEST} SELECT * FROM latest'


def status_view(spark: SparkSession, d: str) -> DataFrame:
    return response_latest(spark, d).select("user", "item", feedback.status("choice").alias("status"))


STATUS_SQL = "CASE choice WHEN 'save_later' THEN 'saved' WHEN 'already_read' THEN 'read' WHEN 'not_relevant' THEN 'rejected' ELSE choice END"
STATUS_VIEW = f'WITH {LATEST} SELECT "user", item, {STATUS_SQL} AS status FROM latest'


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return feedback.status_pivot(status_view(spark, d))


STATUS_PIVOT = f"""WITH {LATEST} SELECT "user", count(*) FILTER (choice = 'save_later') AS saved, count(*) FILTER (choice = 'already_read') AS read,
count(*) FILTER (choice = 'not_relevant') AS rejected, count(*) FILTER (choice = 'skipped') AS skipped FROM latest GROUP BY 1"""


def choice_breakdown(spark: SparkSession, d: str) -> DataFrame:
    a = response_latest(spark, d).join(papers(spark, d).select(F.col("doc_id").alias("item"), "lang", "source"), "item", "left")
    return feedback.breakdown(a, "user", ["lang", "source"])


CHOICE_BREAKDOWN = f"""WITH {LATEST}, j AS (SELECT l.*, lang, source FROM latest l LEFT JOIN documents ON doc_id = item),
e AS (SELECT "user", choice, 'all' AS dim, 'all' AS value FROM j UNION ALL SELECT "user", choice, 'lang', coalesce(lang, 'unknown') FROM j UNION ALL SELECT "user", choice, 'source', coalesce(source, 'unknown') FROM j)
SELECT "user", dim, value, choice, count(*) AS n FROM e GROUP BY ALL"""


def meta_review_windows(spark: SparkSession, d: str) -> DataFrame:
    return feedback.review_windows(answers(spark, d), "user", ["ts", "event_id"])


META_REVIEW_WINDOWS = f"""WITH {ANSWERS}, w AS (SELECT "user", row_number() OVER o AS n_answers, count(*) FILTER (choice = 'save_later') OVER f AS saved, count(*) FILTER (choice = 'not_relevant') OVER f AS rejected
  FROM answers WINDOW o AS (PARTITION BY "user" ORDER BY ts, event_id), f AS (PARTITION BY "user" ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT "user", CAST(n_answers AS INTEGER) AS n_answers, saved, rejected FROM w WHERE n_answers % 10 = 0"""


def drift_flags(spark: SparkSession, d: str) -> DataFrame:
    """Over the 30 days before a fixed point in time."""
    recent = answers(spark, d).where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-02-09").cast("timestamp_ntz")))
    return feedback.drift(recent, "user").select("user", "n", F.round("precision", 6).alias("precision"), F.round("read_rate", 6).alias("read_rate"), F.array_join("flags", ",").alias("flags"))


DRIFT_FLAGS = f"""WITH {ANSWERS}, c AS (SELECT "user", count(*) AS n, count(*) FILTER (choice = 'save_later') AS s, count(*) FILTER (choice = 'already_read') AS r, count(*) FILTER (choice = 'not_relevant') AS b
  FROM answers WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-09' GROUP BY 1)
SELECT "user", n, round(s / nullif(s + b, 0), 6) AS precision, round(r / n, 6) AS read_rate,
  concat_ws(',', CASE WHEN n >= 10 AND s / nullif(s + b, 0) < 0.45 THEN 'low_precision' END, CASE WHEN n >= 10 AND r / n > 0.40 THEN 'high_read_rate' END) AS flags FROM c"""


def belief_update(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).select("user", F.concat(F.lit("c"), F.col("item") % 6).alias("code"), "choice", (F.col("value") > 1).alias("reason"))
    prefs = a.select("user", "code").distinct().withColumn("weight", (F.col("user") % 10) / 10)
    return feedback.belief_update(prefs, a).select("user", "code", F.round("weight", 6).alias("weight"), F.round("new_weight", 6).alias("new_weight"))


BELIEF_UPDATE = f"""WITH {ANSWERS}, c AS (SELECT "user", 'c' || (item % 6) AS code, count(*) FILTER (choice = 'save_later') AS s, count(*) FILTER (choice = 'not_relevant') AS r,
  count(*) FILTER (choice = 'not_relevant' AND value > 1) AS why, ("user" % 10) / 10 AS weight FROM answers WHERE item IS NOT NULL GROUP BY ALL)
SELECT "user", code, weight, round(CASE WHEN s >= 3 AND weight <= 0.5 THEN least(1.0, weight + 0.2) WHEN r >= 3 AND why >= 2 THEN greatest(0.1, weight - 0.3) ELSE weight END, 6) AS new_weight FROM c"""


def cycle_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(D.cycle_id(F.col("ts")).alias("cycle")).agg(F.count("*").alias("n"))


CYCLE = "strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-02 05:00:00') + INTERVAL 9 HOUR, '%Y%m%d-%H%M')"
CYCLE_IDS = f"SELECT {CYCLE} AS cycle, count(*) AS n FROM events GROUP BY 1"


def silence_streak(spark: SparkSession, d: str) -> DataFrame:
    """A click is a reply."""
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("member"), D.cycle_id(F.col("ts")).alias("cycle")).agg(F.count_if(F.col("event_type") == "click").alias("replies"))
    return feedback.silence(c).select("member", "cycle", "replies", "streak2")


SILENCE_STREAK = f"""WITH c AS (SELECT user_id AS member, {CYCLE} AS cycle, count(*) FILTER (event_type = 'click') AS replies FROM events GROUP BY ALL)
SELECT member, cycle, replies, coalesce(replies = 0 AND lag(replies) OVER (PARTITION BY member ORDER BY cycle) = 0, false) AS streak2 FROM c"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("member"), "turn", "text")


def reply_classify(spark: SparkSession, d: str) -> DataFrame:
    cued = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" great, but already read"))).otherwise(F.col("text"))
    return _replies(spark, d).select("member", "turn", filters.classify_reply(cued).alias("signal"))


REPLY_CLASSIFY = """SELECT conv_id AS member, turn, CASE WHEN t LIKE '%not relevant%' OR t LIKE '%not interested%' OR t LIKE '%not a fit%' OR t LIKE '%no thanks%' THEN 'thumbs_down'
 WHEN t LIKE '%already read%' OR t LIKE '%already seen%' OR t LIKE '%read this%' THEN 'already_read' WHEN t LIKE '%saved%' THEN 'saved' WHEN t LIKE '%cite%' THEN 'cited'
 WHEN t LIKE '%thanks%' OR t LIKE '%great%' OR t LIKE '%perfect%' OR t LIKE '%will read%' OR t LIKE '%will use%' THEN 'thumbs_up' ELSE 'thread_reply' END AS signal
FROM (SELECT conv_id, turn, lower(CASE WHEN turn % 3 = 0 THEN text || ' great, but already read' ELSE text END) AS t FROM conversations WHERE role = 'user')"""


def non_repliers(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "conversations").select(F.col("conv_id").alias("member")).distinct()
    return feedback.non_repliers(drafts, _replies(spark, d).where("turn >= 2"))


NON_REPLIERS = "SELECT DISTINCT conv_id AS member FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn >= 2)"


def pick_alternate(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("number "), F.col("member") % 5, F.lit(" please"))
    return _replies(spark, d).select("member", "turn", filters.pick_alternate(said, F.array(*map(F.lit, "abc"))).alias("picked"))


PICK_ALTERNATE = "SELECT conv_id AS member, turn, CASE conv_id % 5 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS picked FROM conversations WHERE role = 'user'"


def token_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Repeated words in the last 200 messages of each role: the window is the feature."""
    c = table(spark, d, "conversations").where("role <> 'system'")
    return feedback.token_patterns(c, X.pattern_tokens("text"), "role", [F.desc("conv_id"), F.desc("turn")])


TOKEN_PATTERNS = r"""WITH l AS (SELECT role, text FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations WHERE role <> 'system') WHERE r <= 200),
t AS (SELECT role, unnest(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: trim(x, '.,!?;:()[]"' || chr(39)))) AS token FROM l)
SELECT role, token, count(*) AS n FROM t WHERE length(token) >= 4 AND regexp_matches(token, '^\pL+$') GROUP BY ALL HAVING count(*) >= 2"""


def fsm_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    signal = F.when(F.col("event_type") == "purchase", "thumbs_up").when(F.col("event_type") == "error", "thumbs_down").otherwise("thread_reply")
    replies = e.select(F.col("user_id").alias("member"), F.col("ts").cast("timestamp").alias("ts"), signal.alias("signal"), (F.col("event_id") % 50 == 0).alias("picked"), F.col("event_id").alias("idem_key"))
    return streams.conversations_batch(replies, AS_OF)


_OPEN = "{s} IN ('awaiting', 'reminded', 'awaiting_decision') AND {d} <= {t}"


def _sql_due(s: str, d: str, t: str) -> str:
    over = _OPEN.format(s=s, d=d, t=t)
    return f"CASE WHEN {over} THEN CASE WHEN {s} = 'awaiting' THEN 'reminded' ELSE 'timeout' END ELSE {s} END AS {s}_, CASE WHEN {over} THEN CASE WHEN {s} = 'awaiting' THEN {d} + 86400000 END ELSE {d} END AS {d}_"


FSM_STATES = f"""WITH RECURSIVE e AS (SELECT member, cycle, start, ts, signal, picked, row_number() OVER (PARTITION BY member, cycle ORDER BY ts, signal, picked) AS r FROM (
  SELECT user_id AS member, {CYCLE} AS cycle, epoch_ms(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-02 05:00:00')) AS start, epoch_ms(ts) AS ts,
    CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' ELSE 'thread_reply' END AS signal, event_id % 50 = 0 AS picked FROM events)),
walk AS (SELECT DISTINCT member, cycle, CAST(0 AS BIGINT) AS r, 'awaiting' AS s, start + 86400000 AS d, CAST(NULL AS BIGINT) AS last, 0 AS n FROM e UNION ALL
  SELECT member, cycle, r, CASE WHEN deaf THEN s__ ELSE state END, CASE WHEN deaf THEN d__ WHEN state = 'awaiting_decision' THEN ts + 43200000 END, CASE WHEN deaf THEN last ELSE ts END, n + CAST(NOT deaf AS INTEGER) FROM (
    SELECT *, s__ IN ('decided', 'passed', 'timeout', 'no_rec') OR coalesce(ts <= last, false) AS deaf, CASE WHEN picked THEN 'decided' WHEN signal = 'thumbs_up' THEN 'decided' WHEN signal = 'thumbs_down' THEN 'passed' ELSE 'awaiting_decision' END AS state FROM (
      SELECT *, {_sql_due('s_', 'd_', 'ts')} FROM (SELECT w.member, w.cycle, e.r, e.ts, e.signal, e.picked, w.last, w.n, {_sql_due('s', 'd', 'e.ts')} FROM walk w JOIN e ON e.member = w.member AND e.cycle = w.cycle AND e.r = w.r + 1)))),
done AS (SELECT member, cycle, arg_max(s, r) AS s, arg_max(struct_pack(d := d), r).d AS d, max(n) AS n FROM walk GROUP BY ALL),
once AS (SELECT *, {_sql_due('s', 'd', f"epoch_ms(TIMESTAMP '{AS_OF}')")} FROM done)
SELECT member, cycle, s__ AS state, n AS reply_count FROM (SELECT *, {_sql_due('s_', 'd_', f"epoch_ms(TIMESTAMP '{AS_OF}')")} FROM once)"""


def upsert_papers(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).select("doc_id", "title", F.col("text").alias("abstract"), "year", "is_preprint")
    old = p.where("doc_id % 2 = 0").withColumn("abstract", F.substring("abstract", 1, 500))
    new = p.where("doc_id % 3 = 0").withColumn("title", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("New: "), "title"))).withColumn("year", F.lit(None).cast("int"))
    out = merge.upsert(old, new, ["doc_id"], {"title": "nonempty", "abstract": "longer", "year": "coalesce", "is_preprint": "or"})
    return out.select("doc_id", "title", F.length("abstract").alias("n_abstract"), F.coalesce("year", F.lit(0)).alias("year"), "is_preprint")


UPSERT_PAPERS = f"""WITH {PAPERS}, o AS (SELECT doc_id, title, substr(text, 1, 500) AS a, year, is_preprint FROM papers WHERE doc_id % 2 = 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'New: ' || title END AS title, text AS a, CAST(NULL AS INTEGER) AS year, is_preprint FROM papers WHERE doc_id % 3 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN n.title ELSE coalesce(nullif(n.title, ''), o.title) END AS title,
 CAST(length(CASE WHEN coalesce(length(n.a), 0) > coalesce(length(o.a), 0) THEN n.a ELSE o.a END) AS INTEGER) AS n_abstract, coalesce(o.year, 0) AS year, coalesce(o.is_preprint, false) OR coalesce(n.is_preprint, false) AS is_preprint
FROM o FULL JOIN n ON o.doc_id = n.doc_id"""


def upsert_preserve_approved(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "human_approved").otherwise("draft").alias("status"), F.lit("old").alias("content"), F.lit("p1").alias("provenance"))
    new = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("draft").alias("status"), F.lit("new").alias("content"), F.lit("p2").alias("provenance"))
    return merge.upsert(lab, new, ["doc_id"], {}, protect=F.col("status") == "human_approved", protected=["status", "content"])


UPSERT_PRESERVE_APPROVED = """WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'human_approved' ELSE 'draft' END AS status FROM labels), n AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.status = 'human_approved' THEN o.status ELSE 'draft' END AS status,
 CASE WHEN n.doc_id IS NULL OR o.status = 'human_approved' THEN 'old' ELSE 'new' END AS content, CASE WHEN n.doc_id IS NULL THEN 'p1' ELSE 'p2' END AS provenance FROM o FULL JOIN n ON o.doc_id = n.doc_id"""


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    return merge.insert_if_absent(a.where("event_id % 2 = 0").select("user", "item").distinct(), a.where("event_id % 2 = 1").select("user", "item", "event_id", "choice"), ["user", "item"], ["event_id"])


INSERT_IF_ABSENT = f"""WITH {ANSWERS} SELECT "user", item, min(event_id) AS event_id, arg_min(choice, event_id) AS choice FROM answers a WHERE event_id % 2 = 1
AND NOT EXISTS (SELECT 1 FROM answers o WHERE o.event_id % 2 = 0 AND o."user" = a."user" AND o.item = a.item) GROUP BY "user", item"""


def migration_rewrite(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).select("event_id", "choice", F.create_map(F.lit("k"), F.col("item").cast("string")).alias("choice_detail"))
    out = merge.retire_choice(merge.retire_choice(a, "skipped", "not_relevant", "was"), "skipped", "not_relevant", "was")
    return out.select("event_id", "choice", F.size("choice_detail").alias("n_detail"))


MIGRATION_REWRITE = f"WITH {ANSWERS} SELECT event_id, CASE WHEN choice = 'skipped' THEN 'not_relevant' ELSE choice END AS choice, CASE WHEN choice = 'skipped' THEN 2 ELSE 1 END AS n_detail FROM answers"


def date_window_tiers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    as_of, pre = F.lit("2001-01-01").cast("date"), F.col("o_orderkey") % 2 == 0
    return o.select("o_orderkey", D.within_window(F.col("date"), pre, "strict", as_of).alias("strict"), D.within_window(F.col("date"), pre, "relaxed", as_of).alias("relaxed"))


AGE = "date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01')"
DATE_WINDOW_TIERS = f"SELECT o_orderkey, {AGE} BETWEEN 0 AND CASE WHEN o_orderkey % 2 = 0 THEN 90 ELSE 365 END AS strict, {AGE} BETWEEN 0 AND CASE WHEN o_orderkey % 2 = 0 THEN 180 ELSE 730 END AS relaxed FROM orders"


def tier_escalation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_orderkey") % 7).alias("query"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 2 == 0).alias("is_preprint"), "o_orderkey")
    return filters.tiered_windows(o, F.lit("2001-01-01").cast("date")).select("unit", "o_orderkey", "tier")


TIER_ESCALATION = f"""WITH w AS (SELECT o_custkey AS unit, o_orderkey, o_orderkey % 7 AS q, {AGE} BETWEEN 0 AND CASE WHEN o_orderkey % 2 = 0 THEN 90 ELSE 365 END AS s, {AGE} BETWEEN 0 AND CASE WHEN o_orderkey % 2 = 0 THEN 180 ELSE 730 END AS r FROM orders),
u AS (SELECT unit FROM w GROUP BY unit HAVING count(DISTINCT q) >= 3 AND NOT bool_or(s))
SELECT unit, o_orderkey, 'strict' AS tier FROM w WHERE s UNION ALL SELECT unit, o_orderkey, 'relaxed' FROM w WHERE r AND unit IN (SELECT unit FROM u)"""


def never_recommend(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    doi = lambda k: F.concat(F.lit("https://doi.org/10.1000/"), k)
    sent = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("unit"), doi(F.col("o_orderkey")).alias("doi"))
    read = li.where("l_returnflag = 'R'").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("unit"), doi(F.col("l_partkey")).alias("doi"))
    c = table(spark, d, "customer")
    rules = c.select(F.col("c_custkey").alias("unit"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("10.2000/"), "c_custkey")).otherwise(F.col("c_mktsegment")).alias("term"))
    out = feedback.never_recommend(sent, read, rules)
    return out.select("unit", F.size("dois").alias("n_dois"), F.md5(F.array_join("dois", ",").cast("binary")).alias("dois"), F.array_join("words", ",").alias("words"))


NEVER_RECOMMEND = """WITH d AS (SELECT o_custkey AS unit, '10.1000/' || o_orderkey AS doi FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, '10.1000/' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
 UNION SELECT c_custkey, '10.2000/' || c_custkey FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT unit, count(*) AS n, string_agg(doi, ',' ORDER BY doi) AS s FROM d GROUP BY unit),
w AS (SELECT c_custkey AS unit, lower(c_mktsegment) AS words FROM customer WHERE c_custkey % 2 = 1)
SELECT coalesce(a.unit, w.unit) AS unit, CAST(coalesce(n, 0) AS INTEGER) AS n_dois, md5(coalesce(s, '')) AS dois, coalesce(words, '') AS words FROM a FULL JOIN w ON a.unit = w.unit"""


def ledger_anti(spark: SparkSession, d: str) -> DataFrame:
    """Part lines that no returned line of the customer excludes."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    lines = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("unit"), F.col("l_partkey").alias("item"), "l_returnflag")
    return lines.where("l_returnflag <> 'R'").select("unit", "item").distinct().join(lines.where("l_returnflag = 'R'").select("unit", "item"), ["unit", "item"], "left_anti")


LEDGER_ANTI = """WITH l AS (SELECT o_custkey AS unit, l_partkey AS item, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT DISTINCT unit, item FROM l WHERE f <> 'R' EXCEPT SELECT unit, item FROM l WHERE f = 'R'"""


def tone_lint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(filters.banned_terms("text", BANNED), ",").alias("banned"), X.chars_without_space("text").alias("n_chars"), F.size(filters.over_cap("text", ("the", "and"))).alias("n_over"))


TONE_LINT = r"""SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(l, 'idiot') THEN 'idiot' END, CASE WHEN contains(l, 'moron') THEN 'moron' END, CASE WHEN contains(l, 'stupid') THEN 'stupid' END, CASE WHEN contains(l, 'thank') THEN 'thank' END) AS banned,
CAST(length(regexp_replace(text, '\s', '', 'g')) AS INTEGER) AS n_chars, CAST((length(l) - length(replace(l, 'the', '')) > 3) AS INTEGER) + CAST((length(l) - length(replace(l, 'and', '')) > 3) AS INTEGER) AS n_over
FROM (SELECT *, lower(text) AS l FROM conversations)"""


def profile_sets(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    sets = j.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("p_type")).alias("methods"), F.count_distinct("p_brand").alias("n_brands"))
    return sets.select("l_suppkey", F.array_join("methods", ",").alias("methods"), "n_brands")


PROFILE_SETS = "SELECT l_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS methods, count(DISTINCT p_brand) AS n_brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def method_signature(spark: SparkSession, d: str) -> DataFrame:
    """Counts of value types and of their compounds by nation of the supplier."""
    s, li, p = table(spark, d, "supplier"), table(spark, d, "lineitem"), table(spark, d, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = j.select("s_nationkey", F.concat_ws("×", "p_type", "l_returnflag").alias("compound"))
    return pairs.groupBy("s_nationkey", "compound").agg(F.count("*").alias("n"))


METHOD_SIGNATURE = "SELECT s_nationkey, p_type || '×' || l_returnflag AS compound, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


def topic_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Per source the three leading words of its titles and the number of anchors."""
    from folioflow.operators import lexical

    p = papers(spark, d)
    words = p.select("source", F.explode(X.keyword_tokens("title", STOP)).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))
    top = lexical.top_terms(words, ["source"], "n", "token", 3).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), ",").alias("keywords"))
    anchors = p.groupBy("source").agg(F.count_distinct("doi").alias("n_anchors"))
    return anchors.join(top, "source", "left")


TOPIC_BUNDLE = f"""WITH {PAPERS}, w AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(title), '[a-z]{{4,}}'), lambda t: t NOT IN ('that', 'with', 'this', 'from', 'have'))) AS token FROM papers),
c AS (SELECT source, token, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS r FROM c), k AS (SELECT source, string_agg(token, ',' ORDER BY r) AS keywords FROM t WHERE r <= 3 GROUP BY 1)
SELECT source, count(DISTINCT doi) AS n_anchors, any_value(keywords) AS keywords FROM papers LEFT JOIN k USING (source) GROUP BY source"""


def contract_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = lambda i: F.abs(F.round(F.col("embedding")[i].cast("double") * 100)).cast("int") % 12
    c = e.select(F.col("vec_id"), *[n(i).alias(f"d{i}") for i in range(1, 6)], F.when(F.col("vec_id") % 3 == 0, "q").alias("quote"), F.when(F.col("vec_id") % 10 == 0, "").otherwise("t").alias("title"))
    c = c.withColumn("composite", F.when(F.col("vec_id") % 4 == 0, F.col("d1")).otherwise(F.greatest("d1", "d2", "d3", "d4", "d5")))
    out = dq.check_rules(c, "vec_id", dq.scored_candidate_rules())
    return out.select("vec_id", F.array_join("failed", ",").alias("failed"))


_D = ", ".join(f"CAST(abs(round(CAST(embedding[{i + 1}] AS DOUBLE) * 100)) AS INTEGER) % 12 AS d{i}" for i in range(1, 6))
CONTRACT_CHECK = f"""WITH c AS (SELECT vec_id, {_D} FROM embeddings), g AS (SELECT *, greatest(d1, d2, d3, d4, d5) AS m, CASE WHEN vec_id % 4 = 0 THEN d1 ELSE greatest(d1, d2, d3, d4, d5) END AS x FROM c),
f AS (SELECT vec_id, concat_ws(',', CASE WHEN x <> m THEN 'composite_is_max' END, CASE WHEN m > 10 THEN 'parts_in_range' END, CASE WHEN x >= 7 AND vec_id % 3 <> 0 THEN 'high_needs_quote' END, CASE WHEN vec_id % 10 = 0 THEN 'has_title' END) AS failed FROM g)
SELECT * FROM f WHERE failed <> ''"""


def enum_and_unique(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    return dq.check_enum(a, "choice", ["save_later", "already_read"]).unionByName(dq.check_unique(table(spark, d, "orders"), ["o_custkey"]))


ENUM_AND_UNIQUE = f"""WITH {ANSWERS} SELECT 'enum:choice' AS rule, choice AS value, count(*) AS n FROM answers WHERE choice NOT IN ('save_later', 'already_read') GROUP BY 2
UNION ALL SELECT 'unique:o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 1"""


def readiness(spark: SparkSession, d: str) -> DataFrame:
    return dq.readiness(spark, {t: table(spark, d, t) for t in ("documents", "embeddings", "events", "labels", "pages")})


READINESS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) > 0 AS ready FROM {t}" for t in ("documents", "embeddings", "events", "labels", "pages"))

QUERIES = {f.__name__: f for f in (
    response_latest, status_view, status_pivot, choice_breakdown, meta_review_windows, drift_flags, belief_update, cycle_ids, silence_streak, reply_classify, non_repliers, pick_alternate,
    token_patterns, fsm_states, upsert_papers, upsert_preserve_approved, insert_if_absent, migration_rewrite, date_window_tiers, tier_escalation, never_recommend, ledger_anti, tone_lint,
    profile_sets, method_signature, topic_bundle, contract_check, enum_and_unique, readiness,
)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
