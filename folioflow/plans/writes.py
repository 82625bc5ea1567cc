"""Keyed writes, contracts, bundles and merges over several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.rounding import half_even
from folioflow.operators import dq, feedback, merge, profiles, reports, resolve, synopsis
from folioflow.plans.base import ANSWERS, CHUNK, PAPERS, STOP, answers, papers, table
from folioflow.plans.people import PIECES, _pieces


def upsert_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews by (session, count): the proposal is replaced, applied stays true once it was, and so does its time."""
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("session_id"), (F.col("event_id") % 7).alias("at_count"), F.col("event_id").alias("proposal"), (F.col("event_type") == "click").alias("applied"), F.when(F.col("event_type") == "click", F.col("ts")).alias("applied_at"), F.col("ts").alias("recorded_at"))
    keys, policy = ["session_id", "at_count"], {"applied": "or", "applied_at": "coalesce"}
    old, new = e.where("proposal % 2 = 0"), e.where("proposal % 2 = 1")
    first = merge.last_rows(old, keys, ["proposal"])
    return merge.upsert(first, new, keys, policy, order=["proposal"]).select(*keys, "proposal", "applied", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied_at"), F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("recorded_at"))


_REVIEW = "arg_max(event_id, event_id) AS p, arg_max(event_type = 'click', event_id) AS a, arg_max(struct_pack(t := CASE WHEN event_type = 'click' THEN ts END), event_id).t AS at, arg_max(ts, event_id) AS r"
UPSERT_REVIEWS = f"""WITH o AS (SELECT user_id % 50 AS s, event_id % 7 AS c, {_REVIEW} FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id % 50 AS s, event_id % 7 AS c, {_REVIEW} FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(n.s, o.s) AS session_id, coalesce(n.c, o.c) AS at_count, coalesce(n.p, o.p) AS proposal, coalesce(o.a, FALSE) OR coalesce(n.a, FALSE) AS applied, strftime(coalesce(n.at, o.at), '%Y-%m-%d %H:%M:%S') AS applied_at, strftime(coalesce(n.r, o.r), '%Y-%m-%d %H:%M:%S') AS recorded_at
FROM o FULL JOIN n ON o.s = n.s AND o.c = n.c"""


def upsert_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles by user: preferences and mix that are not given keep their old value, the snapshot is replaced."""
    o = table(spark, d, "orders")
    row = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("snapshot"), F.when(F.col("o_totalprice") > 200_000, F.col("o_orderpriority")).alias("prefs"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("mix"))
    old = merge.last_rows(row("F"), ["user"], ["snapshot"])
    return merge.upsert(old, row("O"), ["user"], {"prefs": "coalesce", "mix": "coalesce"}, order=["snapshot"])


_PROFILE = "o_custkey AS u, max(o_orderkey) AS s, arg_max(struct_pack(p := CASE WHEN o_totalprice > 200000 THEN o_orderpriority END), o_orderkey).p AS p, arg_max(struct_pack(m := CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END), o_orderkey).m AS m"
UPSERT_PROFILES = f"""WITH o AS (SELECT {_PROFILE} FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), n AS (SELECT {_PROFILE} FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT coalesce(n.u, o.u) AS "user", coalesce(n.s, o.s) AS snapshot, coalesce(n.p, o.p) AS prefs, coalesce(n.m, o.m) AS mix FROM o FULL JOIN n ON o.u = n.u"""


def mark_read(spark: SparkSession, d: str) -> DataFrame:
    """Views are marked as read where the user has no mark of the item yet, whatever the case of its DOI."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("member"), "event_type", F.get_json_object("props", "$.k").alias("k"))
    known = e.where("event_type = 'error'").select("member", X.doi_normalize(F.concat(F.lit("https://doi.org/10.1/K"), "k")).alias("doi")).distinct()
    new = e.where("event_type = 'view'").select("member", X.doi_normalize(F.concat(F.lit("doi:10.1/k"), "k")).alias("doi"), "event_id")
    return merge.insert_if_absent(known, new, ["member", "doi"], ["event_id"])


MARK_READ = """WITH e AS (SELECT event_id, user_id AS member, event_type AS t, '10.1/k' || json_extract_string(props, '$.k') AS doi FROM events)
SELECT member, doi, min(event_id) AS event_id FROM e WHERE t = 'view' AND NOT EXISTS (SELECT 1 FROM e o WHERE o.t = 'error' AND o.member = e.member AND o.doi = e.doi) GROUP BY ALL"""


def upsert_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycle states by (cycle, member): everything but the unit is replaced."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("cycle_id"), F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("unit_id"), F.col("l_returnflag").alias("state"), F.col("l_linenumber").alias("reply_count"), "l_orderkey", "l_linestatus")
    keys, cols = ["cycle_id", "member"], ["unit_id", "state", "reply_count", "l_orderkey"]
    old = merge.last_rows(li.where("l_linestatus = 'F'").select(*keys, *cols), keys, ["l_orderkey", "reply_count", "unit_id", "state"])
    new = li.where("l_linestatus = 'O'").select(*keys, *cols)
    return merge.upsert(old, merge.last_rows(new, keys, ["l_orderkey", "reply_count", "unit_id", "state"]), keys, {"unit_id": "keep"})


_CYCLE = "SELECT l_orderkey % 20 AS c, l_suppkey AS m, arg_max(struct_pack(u := l_partkey, s := l_returnflag, n := l_linenumber, k := l_orderkey), (l_orderkey, l_linenumber, l_partkey, l_returnflag)) AS v FROM lineitem WHERE l_linestatus = '{}' GROUP BY ALL"
UPSERT_CYCLES = f"""WITH o AS ({_CYCLE.format('F')}), n AS ({_CYCLE.format('O')})
SELECT coalesce(n.c, o.c) AS cycle_id, coalesce(n.m, o.m) AS member, coalesce(o.v.u, n.v.u) AS unit_id, coalesce(n.v.s, o.v.s) AS state, coalesce(n.v.n, o.v.n) AS reply_count, coalesce(n.v.k, o.v.k) AS l_orderkey FROM o FULL JOIN n ON o.c = n.c AND o.m = n.m"""


def legacy_copy(spark: SparkSession, d: str) -> DataFrame:
    """Old marks, their DOIs in many forms, are copied once each where the ledger lacks them."""
    p = papers(spark, d).where("doi IS NOT NULL").select("doc_id", "source", "doi")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" https://doi.org/"), F.upper("doi"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("DOI: "), "doi")).otherwise(F.col("doi"))
    legacy = p.select("source", X.doi_normalize(raw).alias("doi"), "doc_id")
    ledger = p.where("doc_id % 4 = 0").select("source", X.doi_normalize("doi").alias("doi"))
    return merge.insert_if_absent(ledger, legacy, ["source", "doi"], ["doc_id"])


LEGACY_COPY = f"""WITH {PAPERS} SELECT source, lower(doi) AS doi, min(doc_id) AS doc_id FROM papers p WHERE doi IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM papers o WHERE o.doc_id % 4 = 0 AND o.source = p.source AND lower(o.doi) = lower(p.doi)) GROUP BY source, lower(doi)"""


def synopsis_rows(spark: SparkSession, d: str) -> DataFrame:
    """Synopses written from sentences of documents, some with strings for lists, unknown states, or broken frameworks."""
    k = F.col("doc_id")
    body = F.to_json(F.struct(
        F.col("s1").alias("core_question"), F.when(k % 2 == 0, F.col("w1")).alias("key_findings"), F.when(k % 3 == 0, "human_approved").when(k % 3 == 1, "odd").alias("review_status"),
        F.array(F.struct(F.when(k % 7 != 0, F.col("w1")).alias("name"), F.col("s1").alias("one_line"))).alias("frameworks"), (F.col("n_chars") / 1000).alias("abstract_coverage"), F.array("w1", "w2").alias("manipulations"),
    ))
    p = _pieces(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").where("w1 IS NOT NULL AND w2 IS NOT NULL")
    raw = p.select(k.cast("string").alias("canonical_id"), F.when(k % 11 == 0, F.col("s1")).otherwise(body).alias("body"))
    rows, skipped = synopsis.synopsis_rows(raw, F.lit("2024-01-01"), "v1", "g")
    shown = rows.select("canonical_id", F.md5("core_question").alias("question"), F.array_join("key_findings", ",").alias("findings"), F.array_join("manipulations", ",").alias("manipulations"), "review_status", F.size("frameworks").alias("n"), half_even("abstract_coverage", 6).alias("coverage"), "generated_at", F.lit(None).cast("string").alias("reason"))
    return shown.unionByName(skipped, allowMissingColumns=True)


SYNOPSIS_ROWS = f"""WITH {PIECES}, p AS (SELECT pieces.*, n_chars FROM pieces JOIN documents USING (doc_id) WHERE w1 IS NOT NULL AND w2 IS NOT NULL),
r AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'no JSON object' WHEN doc_id % 7 = 0 THEN 'frameworks' END AS reason FROM p)
SELECT CAST(doc_id AS VARCHAR) AS canonical_id, CASE WHEN reason IS NULL THEN md5(s1) END AS question, CASE WHEN reason IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN w1 ELSE '' END END AS findings, CASE WHEN reason IS NULL THEN w1 || ',' || w2 END AS manipulations,
  CASE WHEN reason IS NULL THEN CASE WHEN doc_id % 3 = 0 THEN 'human_approved' ELSE 'auto_unreviewed' END END AS review_status, CASE WHEN reason IS NULL THEN 1 END AS n, CASE WHEN reason IS NULL THEN round(least(1.0, n_chars / 1000), 6) END AS coverage,
  CASE WHEN reason IS NULL THEN '2024-01-01' END AS generated_at, reason FROM r"""


def scope_queue(spark: SparkSession, d: str) -> DataFrame:
    """Items with their verdicts and synopses, either of which may be missing; a note that an item is out of scope takes it out."""
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label")
    verdicts = table(spark, d, "labels").select(F.col("doc_id").alias("item"), (F.col("quality") == 1).alias("good"))
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.when(F.col("lang") == "de", F.col("source")).alias("out_of_scope_note"))
    both = reports.with_flags(items, verdicts, "item", ["good"]).join(notes, "item", "left")
    return both.where(F.col("out_of_scope_note").isNull()).select("item", "label", "good")


SCOPE_QUEUE = "SELECT vec_id AS item, label, coalesce(l.quality = 1, TRUE) AS good FROM embeddings LEFT JOIN labels l ON l.doc_id = vec_id LEFT JOIN documents t ON t.doc_id = vec_id WHERE t.doc_id IS NULL OR t.lang IS DISTINCT FROM 'de' OR t.source IS NULL"


def answers_joined(spark: SparkSession, d: str) -> DataFrame:
    """Latest answers with the band and tier that the queue gave the item, its paper and its verdict, each of which may be missing."""
    latest = feedback.latest(answers(spark, d), ["user", "item"], ["ts", "event_id"], ["choice"])
    queue = table(spark, d, "orders").groupBy((F.col("o_custkey") % 1000).alias("user"), (F.col("o_orderkey") % 100).alias("item")).agg(F.max("o_orderpriority").alias("tier"))
    p = papers(spark, d).select(F.col("doc_id").alias("item"), "source", "year", "lang")
    verdict = table(spark, d, "labels").select(F.col("doc_id").alias("item"), "quality")
    met = latest.join(queue, ["user", "item"], "left").join(p, "item", "left").join(verdict, "item", "left")
    return met.groupBy("choice", F.coalesce("tier", F.lit("none")).alias("tier"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"), F.count_if(feedback.status("choice") == "saved").alias("saved"))


ANSWERS_JOINED = f"""WITH {ANSWERS}, latest AS (SELECT "user" AS u, item, arg_max(choice, (ts, event_id)) AS choice FROM answers GROUP BY ALL),
q AS (SELECT o_custkey % 1000 AS u, o_orderkey % 100 AS item, max(o_orderpriority) AS tier FROM orders GROUP BY ALL)
SELECT choice, coalesce(tier, 'none') AS tier, coalesce(lang, 'none') AS lang, coalesce(quality, -1) AS quality, count(*) AS n, count(*) FILTER (choice = 'save_later') AS saved
FROM latest l LEFT JOIN q ON q.u = l.u AND q.item = l.item LEFT JOIN documents d ON d.doc_id = l.item LEFT JOIN labels b ON b.doc_id = l.item GROUP BY ALL"""


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many items of each age band a queue has, and of each tier."""
    from folioflow.functions.dates import age_chunk
    from folioflow.plans.base import AS_OF_YEAR

    q = papers(spark, d).select("source", age_chunk(F.col("year"), F.lit(None).cast("string"), AS_OF_YEAR).alias("chunk"), F.when(F.col("is_preprint"), "relaxed").otherwise("strict").alias("tier"))
    return reports.tier_counts(q.withColumnRenamed("source", "unit"), "unit", ["strict", "relaxed"]).join(q.groupBy(F.col("source").alias("unit")).pivot("chunk", ["recent", "mid", "classic"]).count().fillna(0), "unit")


CHUNK_COUNTS = f"""WITH {PAPERS}, c AS (SELECT source AS unit, is_preprint, {CHUNK.format(y="year")} AS chunk FROM papers)
SELECT unit, count(*) FILTER (NOT is_preprint) AS strict, count(*) FILTER (is_preprint) AS relaxed, count(*) FILTER (chunk = 'recent') AS recent, count(*) FILTER (chunk = 'mid') AS mid, count(*) FILTER (chunk = 'classic') AS classic FROM c GROUP BY unit"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: (F.abs(F.round(F.col("embedding")[i].cast("double") * 100)).cast("int") % 11).alias(f"d{i}")
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("u"), F.col("label")).alias("unit_id"), *[part(i) for i in range(1, 6)])


_PARTS = ", ".join(f"CAST(abs(round(CAST(embedding[{i + 1}] AS DOUBLE) * 100)) AS INTEGER) % 11 AS d{i}" for i in range(1, 6))
_SCORES = f"s AS (SELECT vec_id, 'u' || label AS unit_id, {_PARTS} FROM embeddings)"


def paper_scores(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as scores of several members for some items."""
    s = _scores(spark, d).select("unit_id", F.concat(F.lit("m"), F.col("vec_id") % 7).alias("member"), (F.col("vec_id") % 40).alias("item"), *[f"d{i}" for i in range(1, 6)])
    return dq.paper_scores(s).select("unit_id", "item", "score", F.round("mean_score", 6).alias("mean_score"), "member")


PAPER_SCORES = f"""WITH {_SCORES}, e AS (SELECT unit_id, vec_id % 40 AS item, 'm' || (vec_id % 7) AS member, greatest(d1, d2, d3, d4, d5) AS score, (d1 + d2 + d3 + d4 + d5) / 5 AS mean FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, item ORDER BY score DESC, mean DESC, member) AS k FROM e) SELECT unit_id, item, score, round(CAST(mean AS DOUBLE), 6) AS mean_score, member FROM r WHERE k = 1"""


def scout_contract(spark: SparkSession, d: str) -> DataFrame:
    """Labels as units, their vectors as candidates in the order of ids; the first of each is the top, and some DOIs are barred."""
    s = _scores(spark, d)
    parts = [f"d{i}" for i in range(1, 6)]
    doi = F.concat(F.lit("10.1/"), "vec_id")
    c = s.select("unit_id", F.col("vec_id").alias("position"), doi.alias("doi"), F.lit("t").alias("title"), *parts, F.when(F.col("vec_id") % 4 == 0, F.col("d1")).otherwise(F.greatest(*parts)).alias("composite"), F.when(F.col("vec_id") % 3 == 0, "q").alias("quote"))
    first = c.groupBy("unit_id").agg(F.min_by(F.struct("doi", "composite", "quote"), "position").alias("t")).select("unit_id", "t.doi", "t.composite", F.col("t.quote").alias("grounding"))
    barred = s.where("vec_id % 2 = 0").select("unit_id", F.concat(F.lit("https://doi.org/"), doi).alias("doi"))
    units = s.select("unit_id").distinct().unionByName(spark.createDataFrame([("none",)], "unit_id string"))
    return dq.scout_contract(units, c, first, barred)


SCOUT_CONTRACT = f"""WITH {_SCORES}, c AS (SELECT unit_id, vec_id, '10.1/' || vec_id AS doi, greatest(d1, d2, d3, d4, d5) AS m, CASE WHEN vec_id % 4 = 0 THEN d1 ELSE greatest(d1, d2, d3, d4, d5) END AS x FROM s),
l AS (SELECT *, lag(x) OVER (PARTITION BY unit_id ORDER BY vec_id) AS before FROM c), u AS (SELECT unit_id, count(*) AS n, bool_or(x > before) AS rises FROM l GROUP BY 1), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY vec_id) = 1)
SELECT unit_id, 'candidates: ' || n AS problem FROM u WHERE n < 3 UNION ALL SELECT 'none', 'candidates: 0' UNION ALL SELECT unit_id, 'not in descending order' FROM u WHERE rises
UNION ALL SELECT unit_id, doi || ': composite is not the maximum' FROM c WHERE x <> m UNION ALL SELECT unit_id, doi || ': high without a quote' FROM c WHERE m >= 7 AND vec_id % 3 <> 0
UNION ALL SELECT unit_id, 'top below the bar' FROM t WHERE x < 7 UNION ALL SELECT unit_id, 'top without grounding' FROM t WHERE vec_id % 3 <> 0 UNION ALL SELECT unit_id, 'top is barred: ' || doi FROM t WHERE vec_id % 2 = 0"""


def active_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are still active, and those that are not, with which of the two they are; missing values are violations."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("phase"), F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice") / 500_000).alias("confidence"))
    good, bad = dq.active(o, F.col("phase").isin("F", "O") & (F.col("confidence") >= 0.5))
    return good.select("o_orderkey", F.lit(True).alias("active")).unionByName(bad.select("o_orderkey", F.lit(False).alias("active")))


ACTIVE_ROWS = "SELECT o_orderkey, coalesce(o_orderstatus IN ('F', 'O') AND CASE WHEN o_totalprice > 100000 THEN o_totalprice / 500000 END >= 0.5, FALSE) AS active FROM orders"


def topic_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Regions as units of nations; documents as their projects, in JSON made of their sentences and words."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    units = nation.select(F.col("r_name").alias("unit_id"), F.col("n_name").alias("member"), F.col("n_nationkey").alias("place"))
    p = _pieces(spark, d).where("w1 IS NOT NULL AND w2 IS NOT NULL").join(nation.select("n_nationkey", "n_name"), F.col("doc_id") % 25 == F.col("n_nationkey"))
    js = lambda *c: F.to_json(F.struct(*c))
    projects = p.select(
        F.col("n_name").alias("init"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("project_slug"), F.col("w1").alias("title"), js(F.col("s1").alias("research_question"), F.col("s2").alias("hypothesis")).alias("purpose"),
        js(F.array(F.struct(F.col("w1").alias("name"), F.array("w2").alias("values"))).alias("independent_vars"), F.array("w2").alias("dependent_vars")).alias("variables"), js(F.array("source").alias("shared_paradigm_with")).alias("graph"),
        js(F.array(F.struct(F.concat(F.lit("https://doi.org/10.1/"), "w1").alias("doi"))).alias("prior_studies")).alias("background"),
    )
    out = profiles.topic_bundles(units, projects, STOP)
    return out.select("unit_id", F.array_join("members", ",").alias("members"), "n_projects", F.array_join("keywords", ",").alias("keywords"), F.size("anchor_dois").alias("n_dois"), F.md5(F.array_join("anchor_dois", ",")).alias("dois"), F.md5("gist").alias("gist"))


TOPIC_BUNDLES = rf"""WITH {PIECES}, u AS (SELECT r_name AS unit_id, n_name AS member, n_nationkey AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT unit_id, place, doc_id, w1, w2, s1, coalesce(s2, '') AS s2, concat_ws(' ', s1, s2, w1, w2, w2, source) AS t FROM pieces JOIN u ON doc_id % 25 = place WHERE w1 IS NOT NULL AND w2 IS NOT NULL),
l AS (SELECT unit_id, place, doc_id, [x FOR x IN regexp_extract_all(lower(t), '[a-z]{{4,}}') IF x NOT IN ({", ".join(f"'{w}'" for w in STOP)})] AS l FROM p),
k AS (SELECT unit_id, place, doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM l),
c AS (SELECT unit_id, token, count(*) AS n, min((place, doc_id, i)) AS f FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, f) AS rank FROM c),
kw AS (SELECT unit_id, string_agg(token, ',' ORDER BY rank) AS keywords FROM r WHERE rank <= 25 GROUP BY 1),
dd AS (SELECT unit_id, count(*) AS n, string_agg(doi, ',' ORDER BY doi) AS s FROM (SELECT DISTINCT unit_id, '10.1/' || lower(w1) AS doi FROM p) GROUP BY 1),
g AS (SELECT unit_id, string_agg(concat_ws(' ', w1, CASE WHEN length(s1) < 200 THEN nullif(regexp_replace(s1, '^\s+|\s+$', '', 'g'), '') END), ' ' ORDER BY place, doc_id) AS raw, count(*) AS n FROM p GROUP BY 1),
gw AS (SELECT unit_id, n, raw, [x FOR x IN regexp_split_to_array(raw, '\s+') IF x <> ''] AS w FROM g)
SELECT unit_id, (SELECT string_agg(member, ',' ORDER BY place) FROM u WHERE u.unit_id = gw.unit_id) AS members, gw.n AS n_projects, keywords, CAST(dd.n AS INTEGER) AS n_dois, md5(dd.s) AS dois, md5(CASE WHEN len(w) > 60 THEN array_to_string(w[1:60], ' ') || '…' ELSE raw END) AS gist FROM gw JOIN kw USING (unit_id) JOIN dd USING (unit_id)"""


def federated_search(spark: SparkSession, d: str) -> DataFrame:
    """Sources as lanes: thirty results in turn, each once, new enough: a capped report."""
    p = papers(spark, d)
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    lanes = p.select(F.col("source").alias("lane"), place.alias("pos"), "doi", "title", F.concat("year", F.lit("-06-01")).alias("date"), "is_preprint", F.col("text").alias("abstract"))
    return resolve.federated(lanes, "2015-01-01", "2018-01-01", 30).select("key", "pos", "lane", "date", F.length("abstract").alias("n"))


FEDERATED_SEARCH = rf"""WITH {PAPERS}, l AS (SELECT source AS lane, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, doi, title, year || '-06-01' AS date, is_preprint, text FROM papers),
k AS (SELECT *, coalesce(doi, substr(regexp_replace(trim(lower(title)), '\s+', ' ', 'g'), 1, 80)) AS key FROM l WHERE title <> ''),
g AS (SELECT key, min(struct_pack(pos := pos, lane := lane)) AS p, arg_max(struct_pack(d := date, i := is_preprint, n := length(text)), (length(text), -pos, lane)) AS b FROM k GROUP BY key)
SELECT key, CAST(p.pos AS INTEGER) AS pos, p.lane AS lane, b.d AS date, CAST(b.n AS INTEGER) AS n FROM g WHERE b.d >= CASE WHEN b.i THEN '2018-01-01' ELSE '2015-01-01' END ORDER BY p.pos, p.lane, key LIMIT 30"""


def evolution_log(spark: SparkSession, d: str) -> DataFrame:
    """Turns of users as feedback: the latest two hundred, in the cycle of their conversations, and who was silent twice."""
    t = table(spark, d, "conversations").where("role = 'user'")
    signal = F.when(F.col("turn") % 4 == 0, "thumbs_down").when(F.col("turn") % 4 == 2, "already_read").otherwise("saved")
    doi = F.concat(F.lit("10.1/"), F.col("conv_id") % 3)
    events = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("occurred_at"), signal.alias("signal"), F.col("conv_id").alias("member"), F.concat(F.lit("u"), "conv_id").alias("unit_id"), doi.alias("doi"), "text")
    c = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit("20240105"), F.lit("20240112"), F.lit("20240119"))).alias("cycle_id"))
    quiet = F.when((F.col("conv_id") % 5 == 0) & (F.col("cycle_id") > "20240106"), 0).when(F.col("conv_id") % 2 == 0, 1)
    cycles = c.select("cycle_id", F.col("conv_id").alias("member"), F.concat(F.lit("u"), "conv_id").alias("unit_id"), F.when(F.col("conv_id") % 10 == 5, "timeout").when(F.col("conv_id") % 3 == 0, "no_rec").otherwise("decided").alias("state"), F.when(F.col("conv_id") % 4 != 0, doi).alias("doi"), quiet.alias("reply_count"))
    return feedback.evolution(events, cycles, "20240119").groupBy("change_type", "unit_id", "detail_json", "source").agg(F.count("*").alias("n"))


EVOLUTION_LOG = r"""WITH e AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'thumbs_down' WHEN 2 THEN 'already_read' ELSE 'saved' END AS signal, '10.1/' || (conv_id % 3) AS doi FROM conversations WHERE role = 'user' ORDER BY conv_id * 100 + turn DESC, conv_id * 1000 + turn DESC LIMIT 200),
x AS (SELECT CASE signal WHEN 'already_read' THEN 'read_doi' ELSE 'exclusion_keyword' END AS change_type, 'u' || conv_id AS unit_id, '{"doi":"' || doi || '","signal":"' || signal || '","member":' || conv_id || '}' AS detail_json, 'feedback' AS source FROM e WHERE signal <> 'saved' AND conv_id % 4 <> 0),
w AS (SELECT trim(unnest(regexp_split_to_array(lower(text), '\s+')), '.,!?;:()[]"''') AS t FROM e WHERE signal = 'thumbs_down'),
p AS (SELECT t, count(*) AS n FROM w WHERE length(t) >= 4 AND regexp_full_match(t, '\pL+') GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT DISTINCT conv_id AS m FROM conversations),
s AS (SELECT m FROM c WHERE (m % 5 = 0 OR m % 2 <> 0) AND (m % 10 = 5 OR m % 3 = 0))
SELECT change_type, unit_id, detail_json, source, count(*) AS n FROM (SELECT * FROM x UNION ALL SELECT 'query_seed_drop', '', '{"token":"' || t || '","count":' || n || '}', 'feedback:pattern' FROM p
UNION ALL SELECT 'criteria', 'u' || m, '{"flag":"silence_streak_2","member":' || m || '}', 'silence_pattern' FROM s) GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (
    upsert_reviews, upsert_profiles, mark_read, upsert_cycles, legacy_copy, synopsis_rows, scope_queue, answers_joined, chunk_counts, paper_scores, scout_contract, active_rows, topic_bundles, federated_search, evolution_log,
)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
