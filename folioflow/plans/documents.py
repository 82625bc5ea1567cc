"""Document queries: corpus statistics, tags, verdicts, entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions import text as X
from folioflow.functions.rounding import half_even
from folioflow.functions.scoring import bm25, combo_hits, dim_score, pref_codes
from folioflow.operators import filters, lexical, phrases, profiles, resolve
from folioflow.plans.base import PAPERS, STOP, papers, table

#: Small synthetic parameter tables from the vocabulary of the test data; real ones are passed in.
TAXONOMY = {
    ("focus", "IDI"): ["idiot", "moron"], ("focus", "CLO"): ["clown", "loser", "the and"], ("method", "ER"): ["erth", "erin", "ER"],
    ("method", "ING"): ["inging", "ingor"], ("stim", "EAU"): ["eaux", "eauou"], ("subj", "CHE"): ["keit", "heit", "OST"],
}
COMBOS = [("c1", "relevance", ["ER", "ING"]), ("c2", "guard", ["ER"]), ("c3", "relevance", ["IDI", "ER"]), ("c4", "relevance", ["CLO", "ING", "ER"])]
SCOPE = {"T1": ["idiot", "stupid"], "T2": ["license", "copyright"], "T3": ["token"]}
VENUES = ["src1", "src7"]
WANTED = ["thing", "onand", "ereth", "keit", "queio", "ciónes"]
UNWANTED = ["idiot", "moron", "casino", "license", "token", "###", "!!"]


def _token_idf(spark: SparkSession, d: str) -> DataFrame:
    out = lexical.corpus_idf(table(spark, d, "documents"), X.corpus_tokens("text"))
    return out.select("token", "df", half_even("idf", 3).alias("idf"))


def corpus_idf(spark: SparkSession, d: str) -> DataFrame:
    return _token_idf(spark, d)


SQL_R3 = "CAST(printf('%.3f', {x}) AS DOUBLE)"
SQL_N = "n AS (SELECT count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> '')"
SQL_IDF = f"""tokens AS (SELECT DISTINCT doc_id, unnest([t FOR t IN regexp_extract_all(lower(text), '{X.CORPUS_TOKEN}') IF length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')]) AS token FROM documents), {SQL_N},
tidf AS (SELECT token, df, {SQL_R3.format(x="ln((n + 1) / (df + 1)) + 1")} AS idf FROM (SELECT token, count(*) AS df FROM tokens GROUP BY token), n)"""
CORPUS_IDF = f"WITH {SQL_IDF} SELECT token, df, idf FROM tidf"


def _item_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark items, and the sentences that they consist of."""
    items = table(spark, d, "benchmark").where("trim(text) <> ''")
    pieces = items.select(F.explode(F.split("text", r"\. ")).alias("phrase")).where("trim(phrase) <> ''")
    return items.select(F.col("text").alias("phrase")).unionByName(pieces).distinct()


def phrase_idf(spark: SparkSession, d: str) -> DataFrame:
    out = lexical.phrase_idf(table(spark, d, "documents"), _item_phrases(spark, d))
    return out.select("phrase", "df", half_even("idf", 3).alias("idf"))


PHRASE_IDF = f"""WITH {SQL_N}, p AS (SELECT text AS phrase FROM benchmark WHERE trim(text) <> '' UNION SELECT phrase FROM (SELECT unnest(string_split(text, '. ')) AS phrase FROM benchmark) WHERE trim(phrase) <> ''),
c AS (SELECT phrase, count(doc_id) AS df FROM p LEFT JOIN (SELECT doc_id, lower(text) AS low FROM documents) ON contains(low, lower(phrase)) GROUP BY phrase)
SELECT phrase, df, {SQL_R3.format(x="ln((n + 1) / (df + 1)) + 1")} AS idf FROM c, n"""


def _user_texts(spark: SparkSession, d: str, user: str) -> DataFrame:
    """documents as project texts in three channels."""
    channel = F.element_at(F.array(*map(F.lit, ["anchor", "paradigm", "context"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select(F.col(user).alias("user"), channel.alias("channel"), "text")


def fingerprint_texts(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of sources as users: whole benchmark items as lexicon, salvage where few of them stand in a user's texts."""
    docs = table(spark, d, "documents")
    lexicon = table(spark, d, "benchmark").where("trim(text) <> ''").select(F.col("text").alias("phrase")).distinct()
    idf = lexical.phrase_idf(docs, lexicon).select("phrase", half_even("idf", 3).alias("idf"))
    out = profiles.text_fingerprint(_user_texts(spark, d, "source"), lexicon, idf, _token_idf(spark, d))
    return out.select("user", "phrase", "score", F.array_join("channels", ",").alias("channels"), "n_hits", "rank")


SQL_TEXTS = """t AS (SELECT {user} AS "user", ['anchor', 'paradigm', 'context'][doc_id % 3 + 1] AS channel, lower(text) AS low FROM documents WHERE {user} IS NOT NULL),
w AS (SELECT * FROM (VALUES ('anchor', 1.0), ('paradigm', 0.8), ('context', 0.4)) v(channel, w))"""
SQL_SALVAGE = f"""words AS (SELECT "user", channel, unnest([x FOR x IN regexp_extract_all(low, '{X.SALVAGE_TOKEN}') IF length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({", ".join(f"'{x}'" for x in V.SALVAGE_STOP)})]) AS token FROM t),
tf AS (SELECT "user", token, sum(n * w) AS tf FROM (SELECT "user", channel, token, CAST(count(*) AS DOUBLE) AS n FROM words GROUP BY ALL) JOIN w USING (channel) GROUP BY ALL),
salvaged AS (SELECT "user", token AS phrase, {SQL_R3.format(x="tf * idf")} AS score, CAST(round_even(tf, 0) AS BIGINT) AS n_hits FROM tf JOIN tidf USING (token) WHERE idf >= 4.0
  QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY score DESC, phrase) <= 15)"""
FINGERPRINT_TEXTS = f"""WITH {SQL_IDF}, {SQL_TEXTS.format(user="source")}, {SQL_SALVAGE},
p AS (SELECT DISTINCT text AS phrase, lower(text) AS low FROM benchmark WHERE trim(text) <> ''),
pidf AS (SELECT phrase, low, {SQL_R3.format(x="ln((n + 1) / (df + 1)) + 1")} AS idf FROM (SELECT phrase, p.low, count(d.low) AS df FROM p LEFT JOIN (SELECT lower(text) AS low FROM documents) d ON contains(d.low, p.low) GROUP BY ALL), n),
h AS (SELECT "user", phrase, channel, idf, sum((length(t.low) - length(replace(t.low, p.low, ''))) // length(p.low)) AS k FROM t JOIN pidf p ON contains(t.low, p.low) GROUP BY ALL),
hits AS (SELECT "user", phrase, {SQL_R3.format(x="sum(k * (w * idf))")} AS score, string_agg(channel, ',' ORDER BY channel) AS channels, CAST(sum(k) AS BIGINT) AS n_hits FROM h JOIN w USING (channel) GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, phrase) AS r FROM hits QUALIFY r <= 50),
few AS (SELECT u."user", count(k.phrase) AS n FROM (SELECT DISTINCT "user" FROM t) u LEFT JOIN kept k USING ("user") GROUP BY ALL HAVING count(k.phrase) <= 3)
SELECT "user", phrase, score, channels, n_hits, CAST(r AS INTEGER) AS rank FROM kept
UNION ALL SELECT s."user", phrase, score, '{V.SALVAGE_CHANNEL}', n_hits, CAST(n + row_number() OVER (PARTITION BY s."user" ORDER BY score DESC, phrase) AS INTEGER) FROM salvaged s JOIN few USING ("user")
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k."user" = s."user" AND lower(k.phrase) = lower(s.phrase))"""


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """Twenty best documents for five fixed phrases: a top-k report."""
    weighted = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("score")) for p, w in (("idiot", 5.0), ("thing", 2.0), ("license", 4.0), ("keit", 1.5), ("the and", 3.0))])
    s = table(spark, d, "documents").select("doc_id", F.round(bm25(F.lower("text"), weighted), 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(20)


BM25_TOP = """WITH p AS (SELECT * FROM (VALUES ('idiot', 5.0), ('thing', 2.0), ('license', 4.0), ('keit', 1.5), ('the and', 3.0)) v(p, w)),
d AS (SELECT doc_id, lower(text) AS low, greatest(1, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS n FROM documents),
t AS (SELECT doc_id, CAST(w AS DOUBLE) AS w, n, (length(low) - length(replace(low, p, ''))) // length(p) AS tf FROM d, p)
SELECT doc_id, round(sum(w * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 200.0)))), 6) AS score FROM t GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""".replace("\\\\", "\\")


def _by_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", F.explode(X.keyword_tokens("text", STOP)).alias("token"))


def tfidf_salvage(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen leading tokens of each language among the rarer ones."""
    out = profiles.salvage(_user_texts(spark, d, "lang"), _token_idf(spark, d))
    return out.select(F.col("user").alias("lang"), F.col("phrase").alias("token"), "score", "n_hits")


TFIDF_SALVAGE = f"""WITH {SQL_IDF}, {SQL_TEXTS.format(user="lang")}, {SQL_SALVAGE} SELECT "user" AS lang, phrase AS token, score, n_hits FROM salvaged"""


def keyword_top25(spark: SparkSession, d: str) -> DataFrame:
    tf = _by_lang(spark, d).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return lexical.top_terms(tf, ["lang"], "n", "token", 25)


KEYWORD_TOP25 = """WITH w AS (SELECT lang, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda t: t NOT IN ('that', 'with', 'this', 'from', 'have'))) AS token FROM documents),
s AS (SELECT lang, token, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, token, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM s) WHERE r <= 25"""


def phrase_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Longest-first phrase hits by language, with summed scores."""
    idf = {"the and": 2.0, "and": 1.0, "idiot": 5.0, "ing": 0.5, "thing": 2.5, "license": 4.0}
    lexicon = spark.createDataFrame(list(idf.items()), "phrase string, idf double")
    hits = phrases.phrase_spans(table(spark, d, "documents").select("lang", "source", "text"), lexicon)
    scored = hits.join(F.broadcast(lexicon), "phrase").select("lang", F.col("source").alias("channel"), "phrase", F.col("idf").alias("score"))
    return lexical.merge_phrase_scores(scored, ["lang"]).select("lang", "phrase", F.round("score", 6).alias("score"), F.size("channels").alias("n_channels"), "n_hits")


def _sql_greedy() -> str:
    """Each phrase is counted where no longer one was: those are blotted out first. No phrase overlaps itself."""
    ordered = [("license", 4.0), ("the and", 2.0), ("idiot", 5.0), ("thing", 2.5), ("and", 1.0), ("ing", 0.5)]
    text, parts = "lower(text)", []
    for p, w in ordered:
        parts.append(f"SELECT lang, source, '{p}' AS phrase, {w} AS w, (length(t) - length(replace(t, '{p}', ''))) // {len(p)} AS n FROM (SELECT lang, source, {text} AS t FROM documents)")
        text = f"replace({text}, '{p}', repeat(chr(1), {len(p)}))"
    return " UNION ALL ".join(parts)


PHRASE_GREEDY = f"SELECT lang, phrase, round(CAST(sum(n * w) AS DOUBLE), 6) AS score, CAST(count(DISTINCT source) AS INTEGER) AS n_channels, CAST(sum(n) AS BIGINT) AS n_hits FROM ({_sql_greedy()}) WHERE n > 0 GROUP BY lang, phrase"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    rows = [(dim, code, t) for (dim, code), terms in TAXONOMY.items() for t in terms]
    return lexical.dim_tags(table(spark, d, "documents").select("doc_id", "text"), spark.createDataFrame(rows, "dim string, code string, term string"))


def _sql_hits() -> str:
    parts = []
    for (dim, code), terms in TAXONOMY.items():
        test = []
        for t in terms:
            word = " " not in t and (len(t) <= 5 or t == t.upper())
            test.append(f"CAST(regexp_matches(text, '(^|[^\\pL\\pN_]){t}($|[^\\pL\\pN_])') AS INTEGER)" if word else f"CAST(contains(lower(text), '{t.lower()}') AS INTEGER)")
        parts.append(f"SELECT doc_id, '{dim}' AS dim, '{code}' AS code, {' + '.join(test)} AS hits, {len(terms)} AS n FROM documents")
    return " UNION ALL ".join(parts)


DIM_SQL = f"""hits AS ({_sql_hits()}),
strong AS (SELECT *, least(1.0, hits / sqrt(n)) AS strength FROM hits),
tags AS (SELECT doc_id, dim, code, hits, strength, row_number() OVER (PARTITION BY doc_id, dim ORDER BY strength DESC, code) AS r FROM strong WHERE strength >= 0.15)"""


def dim_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("doc_id", "dim", "code", "hits", F.round("strength", 6).alias("strength"), "rank")


DIM_TAGS = f"WITH {DIM_SQL} SELECT doc_id, dim, code, hits, round(strength, 6) AS strength, CAST(r AS INTEGER) AS rank FROM tags WHERE r <= 3"


def tag_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as codes, their sentences as terms: the first six that stand in a document are the evidence."""
    pieces = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("place", "term"))
    taxonomy = pieces.where("length(term) > 5 AND contains(trim(term), ' ')").select(F.concat(F.lit("b"), (F.col("item_id") % 5).cast("string")).alias("dim"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("code"), "term", "place")
    tags = lexical.dim_tags(table(spark, d, "documents").select("doc_id", "text"), taxonomy, place="place")
    return tags.select("doc_id", "dim", "code", "hits", half_even("strength", 3).alias("strength"), "rank", F.md5(F.array_join("evidence", "|")).alias("evidence"))


TAG_EVIDENCE = f"""WITH p AS (SELECT item_id, unnest(string_split(text, '. ')) AS term, generate_subscripts(string_split(text, '. '), 1) AS place FROM benchmark),
tax AS (SELECT 'b' || (item_id % 5) AS dim, 'i' || item_id AS code, term, place, count(*) OVER (PARTITION BY item_id) AS n FROM p WHERE length(term) > 5 AND contains(trim(term), ' ')),
met AS (SELECT doc_id, dim, code, n, list(term ORDER BY place, term) AS terms FROM documents JOIN tax ON contains(lower(text), lower(term)) GROUP BY ALL),
strong AS (SELECT *, least(1.0, len(terms) / sqrt(n)) AS s FROM met),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dim ORDER BY s DESC, code) AS r FROM strong WHERE s >= 0.15)
SELECT doc_id, dim, code, CAST(len(terms) AS INTEGER) AS hits, {SQL_R3.format(x="s")} AS strength, CAST(r AS INTEGER) AS rank, md5(array_to_string(terms[1:6], '|')) AS evidence FROM top WHERE r <= 3"""


def bags(spark: SparkSession, d: str) -> DataFrame:
    by_dim = _tags(spark, d).groupBy("doc_id", "dim").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return by_dim.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "codes"))).alias("tags"))


def dim_score_query(spark: SparkSession, d: str) -> DataFrame:
    w = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    prefs = F.create_map(F.lit("focus"), w(IDI=0.9, CLO=0.4), F.lit("method"), w(ER=0.6), F.lit("stim"), w(EAU=0.2))
    return bags(spark, d).select("doc_id", F.round(dim_score("tags", prefs), 6).alias("dim_score"))


DIM_SCORE = f"""WITH {DIM_SQL}, w AS (SELECT * FROM (VALUES ('focus', 'IDI', 0.9), ('focus', 'CLO', 0.4), ('method', 'ER', 0.6), ('stim', 'EAU', 0.2)) v(dim, code, w)),
best AS (SELECT doc_id, dim, max(coalesce(w, 0)) AS b FROM tags LEFT JOIN w USING (dim, code) WHERE r <= 3 GROUP BY ALL)
SELECT doc_id, round(CAST(sum(CASE WHEN dim IN ('focus', 'method', 'stim') THEN b ELSE 0 END) AS DOUBLE) / 3, 6) AS dim_score FROM best GROUP BY doc_id"""


def combo_query(spark: SparkSession, d: str) -> DataFrame:
    w = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    prefs = F.create_map(F.lit("focus"), w(IDI=0.9, CLO=0.0), F.lit("method"), w(ING=0.6))
    combos = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r).alias("role"), F.array(*map(F.lit, c)).alias("codes")) for i, r, c in COMBOS])
    bag = F.flatten(F.map_values("tags"))
    return bags(spark, d).select("doc_id", F.array_join(F.sort_array(combo_hits(bag, combos, pref_codes(prefs))), ",").alias("combos"))


COMBO_HITS = f"""WITH {DIM_SQL}, b AS (SELECT doc_id, list(code) AS bag FROM tags WHERE r <= 3 GROUP BY doc_id),
c AS (SELECT * FROM (VALUES ('c1', ['ER', 'ING']), ('c3', ['IDI', 'ER']), ('c4', ['CLO', 'ING', 'ER'])) v(id, codes))
SELECT doc_id, coalesce(string_agg(CASE WHEN list_has_all(bag, codes) AND list_has_any(codes, ['IDI', 'ING']) THEN id END, ',' ORDER BY id), '') AS combos FROM b, c GROUP BY doc_id"""


def taxonomy_priors(spark: SparkSession, d: str) -> DataFrame:
    by = _tags(spark, d).groupBy("dim", "code").agg(F.sum("strength").alias("score"))
    return lexical.normalized_priors(by, ["dim"]).select("dim", "code", F.round("prior", 6).alias("prior"))


TAXONOMY_PRIORS = f"WITH {DIM_SQL}, s AS (SELECT dim, code, sum(strength) AS v FROM tags WHERE r <= 3 GROUP BY ALL) SELECT dim, code, round(v / max(v) OVER (PARTITION BY dim), 6) AS prior FROM s"


def scope_match(spark: SparkSession, d: str) -> DataFrame:
    """Untagged records count as relevant where they come from the curated source."""
    p = papers(spark, d).withColumn("tags", filters.scope_tags("text", "source", SCOPE, VENUES))
    return p.select("doc_id", F.array_join("tags", ",").alias("tags"), filters.relevance("tags", "source", "src3").alias("relevant"))


def _any(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{t}')" for t in terms) + ")"


SCOPE_MATCH = f"""SELECT doc_id, array_to_string(t, ',') AS tags, len(t) > 0 OR coalesce(source = 'src3', FALSE) AS relevant FROM (SELECT doc_id, source, list_filter([{', '.join(f"CASE WHEN {_any('text', v)} THEN '{k}' END" for k, v in SCOPE.items())},
CASE WHEN {_any('source', VENUES)} THEN 'VENUE_OK' END], lambda x: x IS NOT NULL) AS t FROM documents)"""


def filter_verdict(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 7 == 0, F.concat(F.lit("a_draft_"), i, F.lit(".pdf"))).when(i % 11 == 0, F.concat(F.lit("sfn2019_"), i, F.lit(".pdf"))).otherwise("x.pdf")
    title = F.when(i % 13 == 0, F.concat(F.lit("Handbook of "), "title")).when(i % 17 == 0, F.concat(F.lit("P123: "), "title")).when(i % 19 == 0, F.concat(F.lit("Author response: "), "title")).otherwise(F.col("title"))
    df = papers(spark, d).select(
        i.alias("canonical_id"), name.alias("filename"), title.alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"),
        F.lit("x").alias("source"), F.when(i % 23 == 0, "peer-review").alias("source_type"), "doi", "page_count",
    )
    out = filters.verdicts(df, SCOPE, VENUES)
    return out.select(F.col("canonical_id").alias("doc_id"), "is_draft", "is_poster", "is_textbook", "is_review_doc", "is_conf_abstract", "is_lab_relevant", F.size("filter_reason").alias("n_reasons"))


FILTER_VERDICT = f"""WITH {PAPERS}, f AS (SELECT doc_id, doc_id % 7 = 0 AS is_draft, doc_id % 7 <> 0 AND doc_id % 11 = 0 AS is_poster,
  page_count >= 300 OR doc_id % 13 = 0 OR regexp_matches(title, '(?i)\\b(textbook|handbook|encyclopedia|companion to|primer)\\b') AS is_textbook,
  (doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 = 0) OR doc_id % 23 = 0 AS is_review_doc,
  doc_id % 13 <> 0 AND doc_id % 17 = 0 AS is_conf_abstract,
  {' OR '.join(_any('text', v) for v in SCOPE.values())} OR {_any('source', VENUES)} AS relevant FROM papers)
SELECT doc_id, is_draft, is_poster, is_textbook, is_review_doc, is_conf_abstract, relevant AND NOT (is_draft OR is_poster OR is_textbook OR is_review_doc OR is_conf_abstract) AS is_lab_relevant,
  CAST(is_draft AS INTEGER) + CAST(is_poster AS INTEGER) + CAST(is_textbook AS INTEGER) + CAST(is_review_doc AS INTEGER) + CAST(is_conf_abstract AS INTEGER) + CAST(NOT relevant AS INTEGER) AS n_reasons FROM f""".replace("\\\\", "\\")


def oos_classify(spark: SparkSession, d: str) -> DataFrame:
    s = filters.exclusion_score("title", "text", WANTED, UNWANTED)
    return papers(spark, d).withColumn("s", s).select("doc_id", "s.score", "s.verdict")


OOS_CLASSIFY = f"""WITH {PAPERS}, t AS (SELECT doc_id, lower(title) || chr(10) || lower(text) AS low,
  regexp_matches(text, '(?i)^retracted\\b') OR regexp_matches(text, '(?i)\\bcopyright page\\b') AS hard FROM papers),
h AS (SELECT doc_id, hard, {' + '.join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in WANTED)} AS i, {' + '.join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in UNWANTED)} AS o FROM t)
SELECT doc_id, CASE WHEN hard THEN -99 ELSE i - o END AS score, CASE WHEN hard OR i - o <= -2 OR (i - o = -1 AND i = 0) THEN 'oos_template' ELSE 'agent_fanout' END AS verdict FROM h""".replace("\\\\", "\\")


def abstract_gate(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return p.where(filters.abstract_gate("text")).select("doc_id", F.length(X.compose("title", "text", "source", most=1500)).alias("n_composed"))


ABSTRACT_GATE = f"""WITH {PAPERS} SELECT doc_id, CAST(length(substr(concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN title END, text, source), 1, 1500)) AS INTEGER) AS n_composed FROM papers WHERE length(trim(text)) >= 100"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of records that meet in canonical ids."""
    p = papers(spark, d)
    key = X.ascii_title("title")
    cols = ["doc_id", "doi", "title", key.alias("title_norm"), "text", "year", "is_preprint", "source", "n_chars"]
    a = p.where("doc_id % 2 = 0").select(*cols)
    b = p.where("doc_id % 3 <> 1").select(*cols)
    both = resolve.union_sources({"first": a.drop("source"), "second": b.drop("source").withColumn("text", F.concat("text", F.lit("!")))})
    return both.withColumns({"canonical_id": X.canonical_id("doi", "title_norm", "year"), "seq": F.col("doc_id"), "abstract": F.col("text"), "venue": F.lit(None).cast("string"), "authors": F.array(F.concat(F.lit("A"), F.col("doc_id") % 5), F.concat(F.lit("B"), F.col("priority")))})


def merge_exact(spark: SparkSession, d: str) -> DataFrame:
    out = resolve.merge_exact(_records(spark, d))
    return out.select("canonical_id", "doi", "title", "year", F.length("abstract").alias("n_abstract"), F.array_join("authors", ",").alias("authors"), "is_preprint")


RECORDS = f"""{PAPERS}, keyed AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_norm FROM papers),
both_ AS (SELECT *, 0 AS priority, text AS abstract FROM keyed WHERE doc_id % 2 = 0 UNION ALL SELECT *, 1, text || '!' FROM keyed WHERE doc_id % 3 <> 1),
records AS (SELECT *, substr(sha256(CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) ELSE 'ttl:' || title_norm || '|' || year END), 1, 32) AS canonical_id FROM both_)"""
MERGE_EXACT = f"""WITH {RECORDS}, a AS (SELECT canonical_id, priority, doc_id, unnest(['A' || (doc_id % 5), 'B' || priority]) AS author, unnest([0, 1]) AS k FROM records),
al AS (SELECT canonical_id, string_agg(author, ',' ORDER BY f) AS authors FROM (SELECT canonical_id, author, min(priority * 1000000000 + doc_id * 2 + k) AS f FROM a GROUP BY ALL) GROUP BY 1)
SELECT canonical_id, arg_min(doi, priority * 1000000000 + doc_id) AS doi, arg_min(title, priority * 1000000000 + doc_id) FILTER (title <> '') AS title, arg_min(year, priority * 1000000000 + doc_id) AS year,
  CAST(max(length(abstract)) AS INTEGER) AS n_abstract, any_value(authors) AS authors, bool_or(is_preprint OR coalesce(starts_with(doi, '10.1101'), false)) AS is_preprint
FROM records JOIN al USING (canonical_id) GROUP BY canonical_id"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return p.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("canonical_id"), "doi", "title", X.ascii_title("title").alias("title_norm"), F.col("text").alias("abstract"), "year", "is_preprint", F.col("doc_id").alias("seq"))


KEEP = "ORDER BY is_preprint, year DESC, length(abstract) DESC, canonical_id"
RESOLVED = f"{PAPERS}, r AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS canonical_id, doi, title, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_norm, text AS abstract, year, is_preprint FROM papers)"


def title_collapse(spark: SparkSession, d: str) -> DataFrame:
    return resolve.title_collapse(_resolved(spark, d))


TITLE_COLLAPSE = f"""WITH {RESOLVED}, g AS (SELECT *, first_value(canonical_id) OVER w AS keeper, first_value(year) OVER w AS ky FROM r WHERE length(title_norm) >= 25 WINDOW w AS (PARTITION BY title_norm {KEEP}))
SELECT canonical_id AS alias, keeper FROM g WHERE canonical_id <> keeper AND abs(year - ky) <= 6"""


def doi_root_collapse(spark: SparkSession, d: str) -> DataFrame:
    return resolve.doi_root_collapse(_resolved(spark, d))


DOI_ROOT_COLLAPSE = f"""WITH {RESOLVED}, g AS (SELECT *, first_value(canonical_id) OVER w AS keeper FROM r WHERE doi IS NOT NULL WINDOW w AS (PARTITION BY regexp_replace(lower(doi), '_v[0-9]+$', '') {KEEP}))
SELECT canonical_id AS alias, keeper FROM g WHERE canonical_id <> keeper"""


def fuzzy_within_year(spark: SparkSession, d: str) -> DataFrame:
    return resolve.fuzzy_within_year(_resolved(spark, d))


def fuzzy_preprint(spark: SparkSession, d: str) -> DataFrame:
    return resolve.fuzzy_preprint(_resolved(spark, d))


def alias_closure(spark: SparkSession, d: str) -> DataFrame:
    """Chains of three: n -> n - 1 unless n is a multiple of four."""
    a = table(spark, d, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("alias"), (F.col("doc_id") - 1).cast("string").alias("keeper"))
    return resolve.close_aliases(a)


ALIAS_CLOSURE = """WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id - 1 AS k FROM documents WHERE doc_id % 4 <> 0),
walk AS (SELECT a, k FROM e UNION SELECT w.a, e.k FROM walk w JOIN e ON w.k = e.a)
SELECT CAST(a AS VARCHAR) AS alias, CAST(min(k) AS VARCHAR) AS keeper FROM walk GROUP BY a"""


def candidate_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Forty candidates from the sources as lanes: a capped report."""
    p = papers(spark, d)
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    lanes = p.select(F.col("source").alias("lane"), place.alias("pos"), "doi", "title", F.col("year").cast("string").alias("date"), F.col("text").alias("abstract"))
    return resolve.round_robin(lanes, 40).select("key", "pos", "lane", F.length("abstract").alias("n"))


CANDIDATE_ROUND_ROBIN = rf"""WITH {PAPERS}, l AS (SELECT source AS lane, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, doi, title, text FROM papers),
k AS (SELECT *, coalesce(doi, substr(regexp_replace(trim(lower(title)), '\s+', ' ', 'g'), 1, 80)) AS key FROM l WHERE title <> ''),
g AS (SELECT key, min(struct_pack(pos := pos, lane := lane)) AS p, max(length(text)) AS n FROM k GROUP BY key)
SELECT key, CAST(p.pos AS INTEGER) AS pos, p.lane AS lane, CAST(n AS INTEGER) AS n FROM g ORDER BY p.pos, p.lane, key LIMIT 40"""


def inverted_index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All words of each text to a map word -> positions and back."""
    words = F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " ")
    return table(spark, d, "documents").select("doc_id", X.inverted_index_text(X.inverted_index(words)).alias("words"))


INVERTED_INDEX_ROUNDTRIP = r"SELECT doc_id, array_to_string(string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' '), ' ') AS words FROM documents"


def inverted_index_whole(spark: SparkSession, d: str) -> DataFrame:
    """The postings of each text's index: a word and all its places."""
    words = F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " ")
    postings = table(spark, d, "documents").select("doc_id", F.explode(X.inverted_index(words)).alias("word", "at"))
    return postings.select("doc_id", "word", F.size("at").alias("n"), F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("places"))


INVERTED_INDEX_WHOLE = r"""WITH w AS (SELECT doc_id, string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ') AS l FROM documents)
SELECT doc_id, word, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS places FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM w) GROUP BY ALL"""


def xml_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.xml_text("html").cast("binary")).alias("md5"))


XML_STRIP = r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<ref-list\b.*?</ref-list>', ' ', 'g'), '(?is)<back\b.*?</back>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&[#a-zA-Z0-9]+;', ' ', 'g'), '\s+', ' ', 'g'))) AS md5 FROM pages"""


def html_main(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.html_main("html").alias("main"))


def _sql_main() -> str:
    """The article if it shows enough, else the body, without blocks that are no text."""
    without = lambda x, tags: x if not tags else without(rf"regexp_replace({x}, '(?is)<{tags[0]}\b.*?</{tags[0]}>', '', 'g')", tags[1:])
    inner = lambda tag: rf"coalesce(nullif(regexp_extract(d, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), ''), nullif(regexp_extract(d, '(?is)<{tag}\b[^>]*>(.*)$', 1), ''), '')"

    def text(x: str) -> str:
        x = f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"
        for entity, char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("nbsp", "' '"), ("amp", "'&'")):
            x = f"regexp_replace({x}, '&{entity};?', {char}, 'g')"  # the parser knows these names without a semicolon too
        return rf"trim(regexp_replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '\s+', ' ', 'g'))"

    blocks = ["nav", "header", "footer"]
    seen = f"regexp_replace({without('html', ['script', 'style', 'noscript', 'template'])}, '(?s)<!--.*?-->', '', 'g')"
    long = f"length({text(inner('article'))}) > 1200"
    return f"SELECT page_id, CASE WHEN {long} THEN {text(without(inner('article'), blocks))} ELSE {text(without(inner('body'), blocks))} END AS main FROM (SELECT page_id, {seen} AS d FROM pages)"


HTML_MAIN = _sql_main()


def doi_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("https://doi.org/"), F.upper("doi"), F.element_at(F.array(*map(F.lit, [".", ",", ");", ""])), (F.col("doc_id") % 4 + 1).cast("int")))
    p = papers(spark, d).withColumn("raw", raw)
    return p.select("doc_id", X.norm_doi("raw").alias("a"), X.doi_normalize("raw").alias("b"), X.extract_doi(F.concat(F.lit("see "), "raw", F.lit(" there"))).alias("c"))


DOI_NORMALIZE = f"WITH {PAPERS} SELECT doc_id, lower(doi) AS a, lower(doi) || ['.', ',', ');', ''][doc_id % 4 + 1] AS b, lower(doi) AS c FROM papers"


def title_norm(spark: SparkSession, d: str) -> DataFrame:
    """Title keys; the SQL strips accents, which is the same for these languages."""
    return papers(spark, d).select("doc_id", X.norm_title("title").alias("key"))


TITLE_NORM = f"WITH {PAPERS} SELECT doc_id, regexp_replace(strip_accents(lower(title)), '[^a-z0-9]', '', 'g') AS key FROM papers"

QUERIES = {f.__name__: f for f in (
    corpus_idf, phrase_idf, fingerprint_texts, bm25_top, tfidf_salvage, keyword_top25, phrase_greedy, dim_tags, tag_evidence, taxonomy_priors, scope_match, filter_verdict, oos_classify, abstract_gate, merge_exact,
    title_collapse, doi_root_collapse, fuzzy_within_year, fuzzy_preprint, alias_closure, candidate_round_robin, inverted_index_roundtrip, inverted_index_whole, xml_strip, html_main, doi_normalize, title_norm,
)} | {"dim_score": dim_score_query, "combo_hits": combo_query}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
