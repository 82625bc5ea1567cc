"""Session, profile, draft and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dates as D
from folioflow.functions import scoring as S
from folioflow.functions import text as X
from folioflow.operators import drafts, feedback, filters, merge, profiles, reports, resolve, sessions
from folioflow.plans.base import ANSWERS, PAPERS, answers, papers, table
from folioflow.plans.documents import OOS_CLASSIFY, UNWANTED, WANTED, XML_STRIP

AS_OF = "2001-01-01"
BANNED = ["1-urgent"]


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """orders as sessions: those with status O are open."""
    closed = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("started_at"), closed.alias("completed_at"))


def session_open(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return sessions.open_or_reuse(users, _sessions(spark, d), -F.col("user") - 1)


SESSION_OPEN = """WITH o AS (SELECT o_custkey AS "user", arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS sid FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey AS "user", coalesce(sid, -c_custkey - 1) AS session_id, sid IS NOT NULL AS reused FROM customer LEFT JOIN o ON o."user" = c_custkey"""


def session_close(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("at"))
    return sessions.close(_sessions(spark, d), done).select("session_id", F.col("completed_at").cast("date").alias("completed"))


SESSION_CLOSE = """SELECT o_orderkey AS session_id, CAST(coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END, shut) AS DATE) AS completed
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shut FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    issue = F.col("event_type").isin("view", "click")
    item = F.when(F.col("event_id") % 17 != 0, F.col("event_id") % 3)
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.when(issue, "issue").otherwise("answer").alias("kind"), item.alias("item"), F.when(F.col("event_type") == "purchase", "save_later").otherwise("skipped").alias("choice"))


def answer_handshake(spark: SparkSession, d: str) -> DataFrame:
    """An answer counts only if it is to the item issued last."""
    return sessions.handshake(_log(spark, d), ["ts", "event_id"]).where("kind = 'answer'").select("session_id", "event_id", "accepted")


_HANDSHAKE = """e AS (SELECT user_id AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_type IN ('view', 'click') AS issue, CASE WHEN event_id % 17 <> 0 THEN event_id % 3 END AS item, event_type FROM events),
j AS (SELECT a.s, a.event_id, a.r, a.item, a.event_type, i.r AS ir, i.item AS staged FROM e a ASOF LEFT JOIN (SELECT * FROM e WHERE issue) i ON a.s = i.s AND a.r >= i.r WHERE NOT a.issue),
f AS (SELECT s, ir, min(r) AS first FROM j WHERE item = staged GROUP BY ALL)"""
ANSWER_HANDSHAKE = f"WITH {_HANDSHAKE} SELECT j.s AS session_id, event_id, coalesce(r = first, false) AS accepted FROM j LEFT JOIN f ON f.s = j.s AND f.ir = j.ir"


def session_counters(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_counts(sessions.handshake(_log(spark, d), ["ts", "event_id"]))


SESSION_COUNTERS = f"""WITH {_HANDSHAKE}, a AS (SELECT j.s, j.event_type, coalesce(r = first, false) AS ok FROM j LEFT JOIN f ON f.s = j.s AND f.ir = j.ir),
c AS (SELECT s, count(*) FILTER (ok) AS seen, count(*) FILTER (NOT ok) AS refused, count(*) FILTER (ok AND event_type = 'purchase') AS saved FROM a GROUP BY s)
SELECT s AS session_id, coalesce(seen, 0) AS seen, coalesce(refused, 0) AS refused, coalesce(saved, 0) AS saved FROM (SELECT DISTINCT s FROM e) LEFT JOIN c USING (s)"""


def active_projects(spark: SparkSession, d: str) -> DataFrame:
    """orders as projects."""
    phase = F.when(F.col("o_orderstatus") == "F", "analysis").when(F.col("o_orderstatus") == "P", "manuscript_draft").otherwise("idea")
    sure = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100) / 100)
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("init"), F.col("o_orderkey").alias("slug"), phase.alias("phase"), sure.alias("confidence_avg"))
    return profiles.active_projects(p)


ACTIVE_PROJECTS = """SELECT o_custkey AS init, o_orderkey AS slug, CASE o_orderstatus WHEN 'F' THEN 'analysis' ELSE 'manuscript_draft' END AS phase, (o_orderkey % 100) / 100 AS confidence_avg
FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 7 <> 0 AND o_orderkey % 100 >= 70"""


def active_users(spark: SparkSession, d: str) -> DataFrame:
    return active_projects(spark, d).groupBy("init").agg(F.count("*").alias("n"))


ACTIVE_USERS = "SELECT o_custkey AS init, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 7 <> 0 AND o_orderkey % 100 >= 70 GROUP BY 1"


def project_weights(spark: SparkSession, d: str) -> DataFrame:
    """A customer's balance and spending on closed and open orders as weights of three projects: some are negative, or missing."""
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(s) for s in ("F", "O")])
    w = F.when(F.col("c_mktsegment") == "BUILDING", F.array("c_acctbal", "F")).otherwise(F.array("c_acctbal", "F", "O"))
    met = table(spark, d, "customer").join(spent, "c_custkey", "left")
    return met.select("c_custkey", F.posexplode(profiles.project_weights(w, F.lit(3))).alias("i", "w")).select("c_custkey", "i", F.round("w", 6).alias("w"))


PROJECT_WEIGHTS = """WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS b, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS c FROM orders GROUP BY 1),
w AS (SELECT c_custkey, c_acctbal AS a, b, c, c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR coalesce(b < 0, TRUE) OR coalesce(c < 0, TRUE) OR a + b + c = 0 AS bad FROM customer LEFT JOIN s ON k = c_custkey)
SELECT c_custkey, CAST(i AS INTEGER) AS i, round(CASE WHEN bad THEN 1 / 3 ELSE [a, b, c][i + 1] / (a + b + c) END, 6) AS w FROM w, range(3) r(i)"""


def channel_texts(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    p = table(spark, d, "part").withColumn("brand", brand)
    return p.select("p_partkey", profiles.channel_text("p_name", "brand", "p_type").alias("channel"), profiles.interest_text("brand", "p_name").alias("interest"))


CHANNEL_TEXTS = """WITH p AS (SELECT *, CASE WHEN p_size % 3 = 1 THEN p_brand END AS b FROM part)
SELECT p_partkey, concat_ws(' · ', p_name, b, p_type) AS channel, concat_ws(chr(10), b, p_name) AS interest FROM p"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Words and sentences of documents, from which cells and studies are made."""
    word = lambda k: F.get(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lit(k))
    sentence = lambda k: F.get(F.split("text", r"\."), F.lit(k))
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", word(0).alias("w1"), word(1).alias("w2"), sentence(0).alias("s1"), sentence(1).alias("s2"))


PIECES = "pieces AS (SELECT doc_id, text, lang, source, regexp_extract_all(text, '[A-Za-z]+')[1] AS w1, regexp_extract_all(text, '[A-Za-z]+')[2] AS w2, string_split(text, '.')[1] AS s1, string_split(text, '.')[2] AS s2 FROM documents)"


def anchor_dois(spark: SparkSession, d: str) -> DataFrame:
    """DOIs of the studies that a document names in JSON: objects, with sentences as titles, strings, objects without DOI, blanks."""
    p = _pieces(spark, d)
    bare = F.to_json(F.array(F.concat(F.lit("https://doi.org/10.1000/"), "w1"), F.lit("")))
    objects = F.to_json(F.array(F.struct(F.concat(F.lit("doi:10.1000/"), "w2").alias("doi"), F.col("s1").alias("title")), F.struct(F.lit(None).cast("string").alias("doi"), F.col("s2").alias("title"))))
    joined = F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(","), F.substring(objects, F.lit(2), F.length(objects) - 1))
    studies = F.when(F.col("source") != "src1", joined)
    return p.where("w1 IS NOT NULL AND w2 IS NOT NULL").select("doc_id", F.array_join(profiles.harvest_dois(studies), ",").alias("dois"))


ANCHOR_DOIS = f"WITH {PIECES} SELECT doc_id, CASE WHEN source <> 'src1' THEN '10.1000/' || lower(w1) || ',10.1000/' || lower(w2) ELSE '' END AS dois FROM pieces WHERE w1 IS NOT NULL AND w2 IS NOT NULL"


def _fingerprint(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    count = lambda df, c: df.groupBy(F.col("l_suppkey").alias("user"), c.alias("phrase")).agg(F.count("*").cast("double").alias("score"))
    hits = count(j.where("l_suppkey % 2 = 0 OR l_partkey % 97 = 0"), F.col("p_type"))
    return profiles.fingerprint(hits, count(j, F.lower("p_type")).unionByName(count(j, F.col("p_brand"))))


def fingerprint_build(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with few lexicon hits get salvaged phrases that they lack."""
    return _fingerprint(spark, d).select("user", "phrase", "score", "pass", "rank")


_FINGERPRINT = """j AS (SELECT l_suppkey AS "user", p_type, p_brand, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
hits AS (SELECT "user", p_type AS phrase, CAST(count(*) AS DOUBLE) AS score FROM j WHERE "user" % 2 = 0 OR l_partkey % 97 = 0 GROUP BY ALL),
salv AS (SELECT "user", lower(p_type) AS phrase, CAST(count(*) AS DOUBLE) AS score FROM j GROUP BY ALL UNION ALL SELECT "user", p_brand, count(*) FROM j GROUP BY ALL),
b AS (SELECT *, 0 AS pass FROM hits UNION ALL SELECT *, 1 FROM salv s WHERE (SELECT count(*) FROM hits h WHERE h."user" = s."user") <= 3 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h."user" = s."user" AND lower(h.phrase) = lower(s.phrase))),
fp AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY pass, score DESC, phrase) AS rank FROM b QUALIFY rank <= 50)"""
FINGERPRINT_BUILD = f'WITH {_FINGERPRINT} SELECT "user", phrase, score, CAST(pass AS INTEGER) AS pass, CAST(rank AS INTEGER) AS rank FROM fp'


def novel_terms(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").where("p_type < 'M' OR p_brand LIKE '%1'").select(F.explode(F.array(F.upper("p_type"), F.upper("p_brand"))).alias("keyword"))
    return profiles.novel_terms(_fingerprint(spark, d), known)


NOVEL_TERMS = f"""WITH {_FINGERPRINT}, k AS (SELECT lower(p_type) AS k FROM part WHERE p_type < 'M' OR p_brand LIKE '%1' UNION SELECT lower(p_brand) FROM part WHERE p_type < 'M' OR p_brand LIKE '%1')
SELECT "user", phrase, CAST(row_number() OVER (PARTITION BY "user" ORDER BY rank) AS INTEGER) AS place FROM fp WHERE lower(phrase) NOT IN (SELECT k FROM k) QUALIFY place <= 30"""


def derived_prefs(spark: SparkSession, d: str) -> DataFrame:
    """Facets of suppliers from the flags of their lines."""
    tags = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("user"), F.col("l_returnflag").alias("dim"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("code")).agg(F.count("*").alias("strength"))
    p = profiles.derived_prefs(tags)
    return p.select("user", F.explode("prefs").alias("dim", "w")).select("user", "dim", F.explode("w").alias("code", "weight"))


DERIVED_PREFS = """WITH c AS (SELECT l_suppkey AS "user", l_returnflag AS dim, l_linestatus || l_linenumber AS code, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT "user", dim, code, round(n / max(n) OVER (PARTITION BY "user", dim), 3) AS weight FROM c"""


def preference_source(spark: SparkSession, d: str) -> DataFrame:
    """Customers: weights by pending orders, else by events as fingerprint, unless an error spoils it, else by a positive balance."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), "c_acctbal")
    prefs = lambda v: F.create_map(F.lit("c"), v.cast("double"))
    verified = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("user")).agg(F.count("*").alias("n")).select("user", prefs(F.col("n")).alias("prefs"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("user"))
    prints = events.agg(F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 20), "bad")).alias("error"), F.collect_set(F.when(F.col("value") > 25, F.col("event_type"))).alias("phrases"), prefs(F.max("value")).alias("prefs"))
    derived = users.select("user", F.when(F.col("c_acctbal") > 0, prefs(F.col("c_acctbal"))).alias("prefs"))
    return profiles.preference_chain(users, verified, prints, derived).select("user", "source", F.coalesce(F.col("prefs")["c"], F.lit(0.0)).alias("weight"))


PREFERENCE_SOURCE = """WITH v AS (SELECT o_custkey AS k, count(*) AS w FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
f AS (SELECT user_id AS k, max(value) AS w FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error' AND value > 20) = 0 AND count(*) FILTER (value > 25) > 0)
SELECT c_custkey AS "user", CASE WHEN v.k IS NOT NULL THEN 'verified' WHEN f.k IS NOT NULL THEN 'fingerprint' WHEN c_acctbal > 0 THEN 'auto' ELSE 'none' END AS source,
CAST(coalesce(v.w, f.w, CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS DOUBLE) AS weight FROM customer LEFT JOIN v ON v.k = c_custkey LEFT JOIN f ON f.k = c_custkey"""


def embedding_batch(spark: SparkSession, d: str) -> DataFrame:
    """Documents that need a vector: not refused and without one."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("canonical_id"))
    verdicts = table(spark, d, "labels").select(F.col("doc_id").alias("canonical_id"), F.when(F.col("quality") == 1, F.col("toxic") == 0).alias("is_lab_relevant"))
    have = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("canonical_id"))
    return profiles.missing_vectors(items, verdicts, have)


EMBEDDING_BATCH = "SELECT doc_id AS canonical_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """orders as candidates of their customer."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.concat(F.lit("10.1000/"), k).alias("doi"), F.col("o_orderpriority").alias("title"), (k % 11).alias("composite"), "o_orderstatus")


def _recs(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return c.groupBy("unit").agg(F.max_by(F.struct("doi", "title"), F.struct("composite", "doi")).alias("r")).select("unit", "r.*")


def draft_alternates(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return drafts.alternates(_recs(spark, d), c, c.where("o_orderstatus = 'F'")).select("unit", "doi", "place")


_DRAFTS = """c AS (SELECT o_custkey AS unit, '10.1000/' || o_orderkey AS doi, o_orderpriority AS title, o_orderkey % 11 AS composite, o_orderstatus FROM orders),
recs AS (SELECT unit, arg_max(doi, (composite, doi)) AS doi, arg_max(title, (composite, doi)) AS title FROM c GROUP BY unit),
alts AS (SELECT unit, doi, title, row_number() OVER (PARTITION BY unit ORDER BY composite DESC, doi) AS place FROM c WHERE composite >= 5 AND o_orderstatus <> 'F' AND (unit, doi) NOT IN (SELECT (unit, doi) FROM recs) QUALIFY place <= 6)"""
DRAFT_ALTERNATES = f"WITH {_DRAFTS} SELECT unit, doi, CAST(place AS INTEGER) AS place FROM alts"


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    recs = _recs(spark, d)
    return drafts.assemble(recs, drafts.alternates(recs, c, c.where("o_orderstatus = 'F'")))


def drafts_assembled(spark: SparkSession, d: str) -> DataFrame:
    shown = drafts.preview(_drafts(spark, d), ["doi", "title"], BANNED)
    return shown.select("unit", "doi", F.array_join("alternates", ",").alias("alternates"), "body", "n_chars", F.size("banned").alias("n_banned"), F.size("missing").alias("n_missing"))


DRAFTS_ASSEMBLED = rf"""WITH {_DRAFTS}, l AS (SELECT unit, string_agg(doi, ',' ORDER BY place) AS alternates, string_agg(place || '. ' || title || ' · https://doi.org/' || doi, chr(10) ORDER BY place) AS lines FROM alts GROUP BY unit),
b AS (SELECT unit, doi, coalesce(alternates, '') AS alternates, concat_ws(chr(10), title, 'https://doi.org/' || doi, lines) AS body FROM recs LEFT JOIN l USING (unit))
SELECT unit, doi, alternates, body, CAST(length(regexp_replace(body, '\s', '', 'g')) AS INTEGER) AS n_chars, CAST(contains(lower(body), '1-urgent') AS INTEGER) AS n_banned, 0 AS n_missing FROM b"""


def followup_drafts(spark: SparkSession, d: str) -> DataFrame:
    replied = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("unit"))
    return drafts.followups(_drafts(spark, d), replied, BANNED).select("unit", "doi", "body")


FOLLOWUP_DRAFTS = f"""WITH {_DRAFTS} SELECT unit, doi, 'Did you see "' || title || '" (https://doi.org/' || doi || ')?' AS body FROM recs
WHERE lower(title) <> '1-urgent' AND unit NOT IN (SELECT user_id FROM events WHERE event_type = 'click')"""


def acknowledgement_drafts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id")
    replies = table(spark, d, "events").groupBy(k.alias("unit"), F.col("event_type").alias("signal")).agg(
        F.when(F.max("event_id") % 2 == 0, F.concat(F.lit("10.9/"), F.max("event_id"))).alias("picked"), F.when(F.max("event_id") % 3 == 0, "review").alias("excluded")
    )
    return drafts.acknowledgements(replies, _drafts(spark, d), {"click": "Noted.", "view": "Seen."}, "Thank you.", BANNED)


ACKNOWLEDGEMENT_DRAFTS = f"""WITH {_DRAFTS}, r AS (SELECT user_id AS unit, event_type AS signal, max(event_id) AS e FROM events GROUP BY ALL)
SELECT r.unit, signal, coalesce(doi, '') AS doi, concat_ws(' ', '"' || coalesce(title, '-') || '":', CASE signal WHEN 'click' THEN 'Noted.' WHEN 'view' THEN 'Seen.' ELSE 'Thank you.' END,
  CASE WHEN e % 2 = 0 THEN 'Next: 10.9/' || e || '.' END, CASE WHEN e % 3 = 0 THEN 'Excluded: review.' END) AS body FROM r LEFT JOIN recs ON recs.unit = r.unit WHERE lower(coalesce(title, '')) <> '1-urgent'"""


def barred_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Papers that their unit, here the language, already has under this DOI, or under a similar title."""
    p = papers(spark, d).where("lang IS NOT NULL").select(F.col("lang").alias("unit"), F.coalesce("doi", F.concat(F.lit("x"), "doc_id")).alias("doi"), "title", "doc_id")
    return drafts.barred(p.where("doc_id % 2 = 0"), p.where("doc_id % 20 = 2"), p.where("doc_id % 2 = 1"))


def carry_over(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.concat(F.lit("10.1/"), "o_orderkey").alias("doi"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 2 == 0).alias("is_preprint"))
    c = table(spark, d, "customer")
    excluded = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("unit"), F.lit("URGENT").alias("term")).unionByName(pool.where("date_format(date, 'd') = '7'").select("unit", F.upper("doi").alias("term")))
    return drafts.carry_over(pool, F.lit(AS_OF).cast("date"), excluded).select("unit", "doi")


CARRY_OVER = f"""SELECT o_custkey AS unit, '10.1/' || o_orderkey AS doi FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND CASE WHEN o_orderkey % 2 = 0 THEN 90 ELSE 365 END
AND NOT (o_custkey % 3 = 0 AND lower(o_orderpriority) LIKE '%urgent%') AND day(o_orderdate) <> 7"""


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion scores of documents."""
    s = filters.exclusion_score("title", "text", WANTED, UNWANTED)
    return reports.score_histogram(papers(spark, d).withColumn("s", s).select("s.score", (F.col("s.score") == -99).alias("hard")))


SCORE_HISTOGRAM = f"SELECT CASE WHEN score = -99 THEN 'hard' WHEN score <= -2 THEN '<=-2' WHEN score <= 0 THEN '-1..0' WHEN score <= 2 THEN '1..2' ELSE '>=3' END AS bucket, count(*) AS n FROM ({OOS_CLASSIFY}) GROUP BY 1"


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_report(papers(spark, d), {"preprints": F.col("is_preprint"), "no_doi": F.col("doi").isNull(), "long": F.col("page_count") >= 100, "english": F.col("lang") == "en"})


RUN_REPORT = f"WITH {PAPERS} SELECT count(*) AS n, count(*) FILTER (is_preprint) AS preprints, count(*) FILTER (doi IS NULL) AS no_doi, count(*) FILTER (page_count >= 100) AS long, count(*) FILTER (lang = 'en') AS english FROM papers"


def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("score"))
    return reports.tier_counts(e.select("label", S.percentile_tier("score", "score", "label").alias("tier")), "label", ["S", "A", "B", "C"])


TIER_COUNTS = """WITH t AS (SELECT label, CASE WHEN s <= 0.05 AND x >= 0.30 THEN 'S' WHEN s <= 0.20 THEN 'A' WHEN s <= 0.50 THEN 'B' ELSE 'C' END AS tier
 FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY x DESC) / count(*) OVER (PARTITION BY label) AS s FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)))
SELECT label, count(*) FILTER (tier = 'S') AS S, count(*) FILTER (tier = 'A') AS A, count(*) FILTER (tier = 'B') AS B, count(*) FILTER (tier = 'C') AS C FROM t GROUP BY 1"""


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each unit by tier of its date."""
    pre = F.col("o_orderkey") % 2 == 0
    day, as_of = F.col("o_orderdate").cast("date"), F.lit(AS_OF).cast("date")
    tier = F.when(D.within_window(day, pre, "strict", as_of), "strict").when(D.within_window(day, pre, "relaxed", as_of), "relaxed").otherwise("none")
    return reports.tier_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), tier.alias("tier")), "unit", ["strict", "relaxed", "none"])


_AGE = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}')"
CANDIDATE_COUNTS = f"""WITH t AS (SELECT o_custkey AS unit, CASE WHEN {_AGE} BETWEEN 0 AND CASE WHEN o_orderkey % 2 = 0 THEN 90 ELSE 365 END THEN 'strict' WHEN {_AGE} BETWEEN 0 AND CASE WHEN o_orderkey % 2 = 0 THEN 180 ELSE 730 END THEN 'relaxed' ELSE 'none' END AS tier FROM orders)
SELECT unit, count(*) FILTER (tier = 'strict') AS strict, count(*) FILTER (tier = 'relaxed') AS relaxed, count(*) FILTER (tier = 'none') AS none FROM t GROUP BY 1"""


def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return reports.table_digest(table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit(""))), "source", ["doc_id", "text", "lang"])


TABLE_DIGEST = r"""WITH r AS (SELECT coalesce(source, '') AS source, CAST('0x' || substr(sha256(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '\N'), coalesce(text, '\N'), coalesce(lang, '\N'))), 1, 15) AS HUGEINT) AS h FROM documents)
SELECT source, substr(sha256(CAST(sum(h) AS VARCHAR) || '|' || count(*)), 1, 16) AS digest FROM r GROUP BY 1"""


def last_updated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


LAST_UPDATED = "SELECT o_custkey AS unit, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_updated FROM orders GROUP BY 1"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1).alias("good"))


def verdict_flags(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_flags(table(spark, d, "documents").select("doc_id"), _verdicts(spark, d), "doc_id", ["good"])


VERDICT_FLAGS = "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 5 <> 0 THEN quality = 1 END, true) AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def not_refused(spark: SparkSession, d: str) -> DataFrame:
    return reports.without_refused(table(spark, d, "documents").select("doc_id"), _verdicts(spark, d), "doc_id", "good")


NOT_REFUSED = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 5 <> 0 AND quality <> 1)"


def channel_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the name of their nation; some nations are not in the table."""
    known = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("channel"))
    return reports.looked_up(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.broadcast(known), "c_nationkey", "channel", F.concat(F.lit("dm-"), "c_custkey"))


CHANNEL_LOOKUP = "SELECT c_custkey, c_nationkey, coalesce(n_name, 'dm-' || c_custkey) AS channel FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2"


def decorated_items(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their label as a struct, or null."""
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("syn_quality"), F.col("toxic").alias("syn_toxic"))
    out = reports.nested(table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left"), "syn_", "synopsis", ["quality"])
    return out.select("doc_id", F.col("synopsis").isNull().alias("bare"), F.coalesce(F.to_json("synopsis"), F.lit("")).alias("synopsis"))


DECORATED_ITEMS = """SELECT d.doc_id, quality IS NULL AS bare, CASE WHEN quality IS NULL THEN '' ELSE '{"quality":' || quality || ',"toxic":' || toxic || '}' END AS synopsis FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def first_source(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).where("doi IS NOT NULL AND source IS NOT NULL").select("doi", "source", "doc_id")
    return reports.first_source(p, "doi", "doc_id")


FIRST_SOURCE = f"WITH {PAPERS} SELECT doi, arg_min(source, (doc_id, source)) AS source FROM papers WHERE doi IS NOT NULL AND source IS NOT NULL GROUP BY doi"


def mirror_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return reports.with_fallback(e.where("vec_id % 3 = 0").select("vec_id", F.lit("mirror").alias("origin")), e.select("vec_id", F.lit("store").alias("origin")), "vec_id")


MIRROR_FALLBACK = "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'mirror' ELSE 'store' END AS origin FROM embeddings"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("dim"), F.col("l_linestatus").alias("code")).agg(F.sum("l_quantity").alias("strength"))


def stale_tags(spark: SparkSession, d: str) -> DataFrame:
    """Old tags of this tagger go if it did not write them again; those of another version stay."""
    t = _tags(spark, d).withColumn("tagger_version", F.when(F.col("key") % 4 == 0, "v1").otherwise("v2"))
    new = t.where("key % 2 = 0 AND dim <> 'N'").withColumn("tagger_version", F.lit("v2"))
    return reports.fresh_tags(t, new, ["key", "dim", "code"]).select("key", "dim", "code", "tagger_version")


STALE_TAGS = """WITH t AS (SELECT DISTINCT l_orderkey AS key, l_returnflag AS dim, l_linestatus AS code FROM lineitem)
SELECT key, dim, code, CASE WHEN dim <> 'N' THEN 'v2' ELSE 'v1' END AS tagger_version FROM t WHERE (key % 2 = 0 AND dim <> 'N') OR key % 4 = 0"""


def tag_mirror(spark: SparkSession, d: str) -> DataFrame:
    out = reports.mirrored(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), _tags(spark, d), "key")
    return out.select("key", F.coalesce(F.to_json("dim_tags"), F.lit("")).alias("dim_tags"))


TAG_MIRROR = """WITH t AS (SELECT l_orderkey AS key, l_returnflag AS dim, l_linestatus AS code, sum(l_quantity) AS s FROM lineitem GROUP BY ALL),
c AS (SELECT key, dim, string_agg('"' || code || '"', ',' ORDER BY s DESC, code) AS codes FROM t GROUP BY ALL), m AS (SELECT key, '{' || string_agg('"' || dim || '":[' || codes || ']', ',' ORDER BY dim) || '}' AS j FROM c GROUP BY key)
SELECT o_orderkey AS key, coalesce(j, '') AS dim_tags FROM orders LEFT JOIN m ON m.key = o_orderkey"""


def unit_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Units with the number of their projects and their exclusion terms; a unit without any has empty ones."""
    n = active_users(spark, d).select(F.col("init").alias("unit"), "n")
    rules = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("unit"), F.array(F.lower("c_mktsegment")).alias("terms"))
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("unit")).join(n, "unit", "left").join(rules, "unit", "left")
    return out.select("unit", F.coalesce("n", F.lit(0)).alias("n_projects"), F.array_join(F.coalesce("terms", F.array().cast("array<string>")), ",").alias("terms"))


UNIT_BRIEFS = f"""WITH n AS ({ACTIVE_USERS}) SELECT c_custkey AS unit, coalesce(n, 0) AS n_projects, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE '' END AS terms FROM customer LEFT JOIN n ON init = c_custkey"""


def feedback_in_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Answers about what the user was sent: user and item must both fit."""
    a = answers(spark, d)
    return a.where("choice <> 'save_later'").select("event_id", "user", "item").join(a.where("choice = 'save_later'").select("user", "item"), ["user", "item"], "left_semi")


FEEDBACK_IN_CYCLE = f"""WITH {ANSWERS} SELECT event_id, "user", item FROM answers a WHERE choice <> 'save_later' AND EXISTS (SELECT 1 FROM answers o WHERE o.choice = 'save_later' AND o."user" = a."user" AND o.item = a.item)"""


def citing_papers(spark: SparkSession, d: str) -> DataFrame:
    """Orders that cite an anchor part: (anchor, n)."""
    anchors = table(spark, d, "part").where("p_size >= 40").select(F.col("p_partkey").alias("anchor"))
    return table(spark, d, "lineitem").join(anchors, F.col("l_partkey") == F.col("anchor")).groupBy("anchor").agg(F.count_distinct("l_orderkey").alias("n"))


CITING_PAPERS = "SELECT l_partkey AS anchor, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 40 GROUP BY 1"


def small_texts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    remark = F.when(F.col("o_orderkey") % 3 == 0, F.lit("keyword-classifier (score=1")).when(F.col("o_orderkey") % 3 == 1, F.lit(" out of scope ")).otherwise(F.lit("Why?"))
    as_of = F.lit("2001-01-01 06:30:00").cast("timestamp")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        "o_orderkey", X.month("day").alias("month"), X.unit_file(F.concat(F.lit("a+b+"), "o_custkey")).alias("unit"), X.note(remark).alias("note"), X.one_of("o_orderstatus", ["F", "P"], "X").alias("status"),
        D.not_before("day", F.col("o_orderkey") % 2 == 0, "1998-06", "2000-01-15").alias("fresh"), D.seoul_text(at).alias("seoul"), F.round(D.hours_left(at, as_of), 3).alias("hours"), D.age_days(at, as_of).alias("age"),
    )


SMALL_TEXTS = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, 'a_b_' || o_custkey AS unit, CASE o_orderkey % 3 WHEN 0 THEN 'keyword-classifier (score=1' WHEN 1 THEN 'out of scope.' ELSE 'Why?' END AS note,
 CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderstatus ELSE 'X' END AS status, strftime(o_orderdate, '%Y-%m-%d') >= CASE WHEN o_orderkey % 2 = 0 THEN '2000-01-15' ELSE '1998-06' END AS fresh,
 strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+09:00') AS seoul, round((epoch(o_orderdate) - epoch(TIMESTAMP '2001-01-01 06:30:00')) / 3600, 3) AS hours, CAST(floor((epoch(TIMESTAMP '2001-01-01 06:30:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS age FROM orders"""


def json_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of words and sentences that should be lists: lists, bare strings, nulls; frameworks with and without names."""
    k = F.col("doc_id") % 5
    p = _pieces(spark, d).where("w1 IS NOT NULL AND w2 IS NOT NULL")
    cell = F.when(k == 0, F.to_json(F.array("w1", "s1", "w2"))).when(k == 1, F.trim("s1")).when(k == 2, "null").when(k == 3, "[]")
    name, role = F.col("w1").alias("name"), F.col("s1").alias("role")
    fw = F.when(k == 0, F.to_json(F.array(F.struct(name, role), F.struct(name, role)))).when(k == 1, F.to_json(F.array(F.struct(role)))).when(k == 2, F.to_json(F.array("w1"))).when(k == 3, F.to_json(F.array(F.struct(F.col("doc_id").alias("name"))))).otherwise(F.to_json(F.struct(name)))
    return p.select("doc_id", F.md5(F.array_join(X.as_array(cell), ",")).alias("items"), F.size(X.as_array(cell)).alias("n"), X.frameworks_ok(fw).alias("ok"))


JSON_CELLS = f"""WITH {PIECES} SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN w1 || ',' || s1 || ',' || w2 WHEN 1 THEN trim(s1) ELSE '' END) AS items,
CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN CAST(trim(s1) <> '' AS INTEGER) ELSE 0 END AS n, doc_id % 5 = 0 AS ok FROM pieces WHERE w1 IS NOT NULL AND w2 IS NOT NULL"""


def recent_answers(spark: SparkSession, d: str) -> DataFrame:
    return feedback.last_rows(answers(spark, d), "user", [F.desc("ts"), F.desc("event_id")]).select("user", "event_id", "recency")


RECENT_ANSWERS = f"""WITH {ANSWERS} SELECT "user", event_id, CAST(row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS INTEGER) AS recency FROM answers QUALIFY recency <= 10"""


def sound_updates(spark: SparkSession, d: str) -> DataFrame:
    """A user's new weights count only if all are sound."""
    u = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("user"), F.concat(F.lit("c"), "l_linenumber").alias("code")).agg(F.count("*").alias("n"))
    u = u.select("user", "code", F.lit(0.5).alias("weight"), ((F.col("n") % 50) / 40).alias("new_weight"))
    codes = spark.createDataFrame([(f"c{i}",) for i in range(1, 8)], "code string")
    return feedback.valid_update(u, codes).select("user", "code", F.round("weight", 6).alias("weight"))


SOUND_UPDATES = """WITH u AS (SELECT l_suppkey AS "user", 'c' || l_linenumber AS code, (count(*) % 50) / 40 AS w FROM lineitem GROUP BY ALL)
SELECT "user", code, round(CASE WHEN bool_and(w BETWEEN 0 AND 1 AND code IN ('c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7')) OVER (PARTITION BY "user") THEN w ELSE 0.5 END, 6) AS weight FROM u"""


def template_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows for excluded documents that have no record yet."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("canonical_id"), F.when(F.col("doc_id") % 4 == 0, "oos_template").otherwise("agent_fanout").alias("verdict"), F.when(F.col("doc_id") % 8 == 0, "fishery").alias("hard_reason"))
    rows, _ = filters.oos_template_rows(c, table(spark, d, "labels").select(F.col("doc_id").alias("canonical_id")))
    return rows.select("canonical_id", F.size("frameworks").alias("n_frameworks"), "coverage", "out_of_scope_note")


TEMPLATE_ROWS = "SELECT doc_id AS canonical_id, 0 AS n_frameworks, CAST(0 AS DOUBLE) AS coverage, CASE WHEN doc_id % 8 = 0 THEN 'fishery.' ELSE 'out of scope.' END AS out_of_scope_note FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)"


def unwritten_keys(spark: SparkSession, d: str) -> DataFrame:
    return merge.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


UNWRITTEN_KEYS = "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"


def aliases_applied(spark: SparkSession, d: str) -> DataFrame:
    """Answers to an alias go to its keeper; the aliases' own rows go."""
    aliases = table(spark, d, "documents").where("doc_id % 3 = 1").select(F.col("doc_id").alias("alias"), (F.col("doc_id") - 1).alias("keeper"))
    a = answers(spark, d).select(F.col("item").alias("canonical_id"), "event_id")
    moved = resolve.apply_aliases(a, aliases).groupBy("canonical_id").agg(F.count("*").alias("n"))
    return resolve.drop_orphans(table(spark, d, "documents").select(F.col("doc_id").alias("canonical_id")), aliases).join(moved, "canonical_id", "left").fillna(0, ["n"])


ALIASES_APPLIED = f"""WITH {ANSWERS}, m AS (SELECT CASE WHEN item % 3 = 1 AND item IN (SELECT doc_id FROM documents) THEN item - 1 ELSE item END AS id, count(*) AS n FROM answers GROUP BY 1)
SELECT doc_id AS canonical_id, coalesce(n, 0) AS n FROM documents LEFT JOIN m ON id = doc_id WHERE doc_id % 3 <> 1"""


def typed_answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    said = F.when(k == 0, "1.").when(k == 1, "Save ").when(k == 2, "skip this one").when(k == 3, "perhaps")
    names = {"1": "save_later", "save": "save_later", "skip": "skipped"}
    return table(spark, d, "events").select("event_id", filters.free_text_choice(said, names).alias("choice"))


TYPED_ANSWERS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'save_later' WHEN 1 THEN 'save_later' WHEN 2 THEN 'skipped' END AS choice FROM events"


def doi_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of several DOIs, and gists of the first two sentences."""
    p = _pieces(spark, d).where("w1 IS NOT NULL AND w2 IS NOT NULL")
    cell = F.concat(F.lit("https://doi.org/10.1000/"), "w1", F.lit("; 10.1000/"), "w2", F.lit(", 10.1000/"), F.upper("w1"), F.lit(";;"))
    return p.select("doc_id", F.array_join(X.split_values(cell), "|").alias("dois"), F.md5(X.gist(F.array("s1"), F.array(F.coalesce("s2", F.lit(""))))).alias("gist"))


DOI_CELLS = rf"""WITH {PIECES}, r AS (SELECT doc_id, w1, w2, concat_ws(' ', nullif(regexp_replace(s1, '^\s+|\s+$', '', 'g'), ''), CASE WHEN length(s2) < 200 THEN nullif(regexp_replace(s2, '^\s+|\s+$', '', 'g'), '') END) AS raw FROM pieces WHERE w1 IS NOT NULL AND w2 IS NOT NULL),
g AS (SELECT *, [x FOR x IN regexp_split_to_array(raw, '\s+') IF x <> ''] AS p FROM r)
SELECT doc_id, '10.1000/' || lower(w1) || CASE WHEN lower(w1) <> lower(w2) THEN '|10.1000/' || lower(w2) ELSE '' END AS dois,
md5(CASE WHEN raw = '' THEN '(no project description available)' WHEN len(p) > 60 THEN array_to_string(p[1:60], ' ') || '…' ELSE raw END) AS gist FROM g"""


def full_text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Pages: the stripped body if it is long enough, else the address if that is, else the page as it came."""
    forms = X.full_text(X.xml_text("html"), "url", "html", 800)
    return table(spark, d, "pages").select("page_id", F.md5(forms).alias("md5"))


_STRIPPED = XML_STRIP.split("md5(", 1)[1].rsplit(") AS md5", 1)[0]
FULL_TEXT_FORMS = f"SELECT page_id, md5(CASE WHEN length(s) > 800 THEN s WHEN length(url) > 800 THEN url WHEN length(html) > 800 THEN html ELSE 'unavailable' END) AS md5 FROM (SELECT *, {_STRIPPED} AS s FROM pages)"


def text_notes(spark: SparkSession, d: str) -> DataFrame:
    """Last lines of documents as notes that end in punctuation, and file names of their units."""
    last = F.element_at(F.split("text", "\n"), -1)
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.md5(X.note(last)).alias("note"), X.unit_file(F.concat_ws("+", "source", "lang")).alias("unit"))


TEXT_NOTES = r"""SELECT doc_id, md5(CASE WHEN starts_with(l, 'keyword-classifier (') THEN l WHEN regexp_matches(trim(l), '[.!?]$') THEN trim(l) ELSE trim(l) || '.' END) AS note, replace(concat_ws('+', source, lang), '+', '_') AS unit
FROM (SELECT *, string_split(text, chr(10))[-1] AS l FROM documents WHERE text <> '')"""

QUERIES = {f.__name__: f for f in (
    session_open, session_close, answer_handshake, session_counters, active_projects, active_users, project_weights, channel_texts, anchor_dois, fingerprint_build, novel_terms, derived_prefs,
    preference_source, embedding_batch, draft_alternates, drafts_assembled, followup_drafts, acknowledgement_drafts, barred_candidates, carry_over, score_histogram, run_report, tier_counts,
    candidate_counts, table_digest, last_updated, verdict_flags, not_refused, channel_lookup, decorated_items, first_source, mirror_fallback, stale_tags, tag_mirror, unit_briefs,
    feedback_in_cycle, citing_papers, small_texts, full_text_forms, text_notes, json_cells, recent_answers, sound_updates, template_rows, unwritten_keys, aliases_applied, typed_answers, doi_cells,
)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
