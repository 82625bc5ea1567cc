"""Queue queries: ranking, tiers, quotas, serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import scoring as S
from folioflow.functions.dates import age_chunk
from folioflow.functions.text import keyword_tokens
from folioflow.operators import feedback, lexical, ranking
from folioflow.plans.base import ANSWERS, AS_OF_YEAR, CHUNK, PAPERS, STOP, answers, papers, table
from folioflow.plans.documents import COMBOS, DIM_SQL, bags

PHRASES = 15


def _items(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    year = F.col("year")
    return papers(spark, d).join(vectors, "doc_id").select(F.col("doc_id").alias("item"), "text", "year", "embedding", "label", age_chunk(year, F.lit(None).cast("string"), AS_OF_YEAR).alias("chunk"))


def _users(spark: SparkSession, d: str, phrases: int = PHRASES) -> DataFrame:
    """Ten users: the labels of the vectors, with the centroid and the leading tf-idf words of their documents."""
    mean = ranking.centroids(table(spark, d, "embeddings"), "label")
    items = _items(spark, d).select("item", "label", "text")
    words = items.select("item", "label", F.explode(keyword_tokens("text", STOP)).alias("token"))
    n = items.agg(F.count("*").alias("n"))
    # An item has one label, so the items of a token are those of its labels together: texts are read once.
    each = words.groupBy("item", "label", "token").agg(F.count("*").alias("tf")).groupBy("label", "token").agg(F.sum("tf").alias("tf"), F.count("*").alias("items"))
    df = each.groupBy("token").agg(F.sum("items").alias("df"))
    idf = df.join(F.broadcast(n)).select("token", F.round(lexical.smoothed_idf("df", F.col("n")), 6).alias("idf"))
    tf = each.drop("items").join(idf, "token").withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    top = lexical.top_terms(tf, ["label"], "score", "token", phrases)
    lists = top.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(F.col("token").alias("phrase"), F.col("idf").alias("score")))).alias("phrases"))
    return mean.join(lists, "label", "left").select(F.col("label").alias("user"), "query", F.coalesce("phrases", F.array().cast("array<struct<phrase:string,score:double>>")).alias("phrases"))


def _pairs(spark: SparkSession, d: str, phrases: int = PHRASES) -> DataFrame:
    zero = {"dim": F.lit(0.0), "n_combos": F.lit(0)}
    return ranking.pairs(_items(spark, d).drop("label", "year"), _users(spark, d, phrases)).withColumns(zero)


SQL_ITEMS = f"""WITH {PAPERS},
items AS (SELECT doc_id AS item, text, year, [CAST(x AS DOUBLE) FOR x IN embedding] AS embedding, label, {CHUNK.format(y="year")} AS chunk
  FROM papers JOIN embeddings ON vec_id = doc_id),
flat AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label AS "user", list(x ORDER BY i) AS query FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM flat GROUP BY label, i) GROUP BY label),
words AS (SELECT item, label, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda t: t NOT IN ('that', 'with', 'this', 'from', 'have'))) AS token FROM items),
idf AS (SELECT token, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM (SELECT token, count(DISTINCT item) AS df FROM words GROUP BY token), (SELECT count(*) AS n FROM items)),
tf AS (SELECT label, token, idf, round(count(*) * idf, 6) AS score FROM words JOIN idf USING (token) GROUP BY label, token, idf),
top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, token) AS r FROM tf),
pairs AS (SELECT item, text, year, chunk, "user", embedding, query FROM items, mean),
cosines AS (SELECT item, text, chunk, "user", coalesce(list_inner_product(embedding, query) / nullif(sqrt(list_inner_product(embedding, embedding)) * sqrt(list_inner_product(query, query)), 0), 0) AS cos FROM pairs)"""
SQL_KW = """,
kw AS (SELECT c.item, c."user", sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / 200.0))) AS raw_kw FROM (
    SELECT c.item, c."user", t.idf, (length(low) - length(replace(low, t.token, ''))) // length(t.token) AS tf, n_words
    FROM (SELECT item, "user", lower(text) AS low, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS n_words FROM cosines) c
    JOIN top t ON t.label = c."user" AND t.r <= {k}) c GROUP BY ALL)""".replace("\\\\", "\\")
SQL_CUT = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user", chunk ORDER BY round(composite, 9) DESC, round(cos, 9) DESC, item) AS rank_in_chunk FROM scored),
kept AS (SELECT * FROM ranked WHERE rank_in_chunk <= CASE chunk WHEN 'recent' THEN 120 WHEN 'mid' THEN 60 ELSE 20 END),
shares AS (SELECT *, rank() OVER (PARTITION BY "user", chunk ORDER BY round(composite, 9) DESC) / count(*) OVER (PARTITION BY "user", chunk) AS share FROM kept)
SELECT "user", item, chunk, CAST(rank_in_chunk AS INTEGER) AS rank_in_chunk, round(cos, 6) AS cos, round(composite, 6) AS composite,
  CASE WHEN share <= 0.05 AND cos >= 0.30 THEN 'S' WHEN share <= 0.20 THEN 'A' WHEN share <= 0.50 THEN 'B' ELSE 'C' END AS tier FROM shares"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("user", "item", "chunk", "rank_in_chunk", F.round("cos", 6).alias("cos"), F.round("composite", 6).alias("composite"), "tier")


def queue_linear(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ranking.cut(ranking.score(_pairs(spark, d), "phrases")))


QUEUE_LINEAR = SQL_ITEMS + SQL_KW.replace("{k}", "15") + """,
raw AS (SELECT item, chunk, "user", cos, greatest(0, cos) AS c, coalesce(tanh(raw_kw / 25), 0) AS k FROM cosines LEFT JOIN kw USING (item, "user")),
scored AS (SELECT *, (1 - exp(-3 * greatest(c, k))) * (0.45 * c + 0.30 * k) AS composite FROM raw WHERE NOT (c < 0.18 AND k < 0.20))""" + SQL_CUT


def queue_no_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Without phrases, of documents that labels call good; absolute tiers."""
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item"))
    pairs = ranking.pair_up(_items(spark, d).drop("label", "text").join(good, "item", "left_semi"), ranking.centroids(table(spark, d, "embeddings"), "label").withColumnRenamed("label", "user"))
    scored = ranking.score(pairs.withColumns({"cos": S.cosine("embedding", "query"), "dim": F.lit(0.0), "n_combos": F.lit(0)}), "plain")
    return ranking.cut(scored).select("user", "item", "chunk", "rank_in_chunk", F.round("composite", 6).alias("composite"), S.absolute_tier("cos", "dim", "n_combos").alias("tier"))


QUEUE_NO_FINGERPRINT = SQL_ITEMS + """,
scored AS (SELECT *, 0.55 * cos AS composite FROM cosines WHERE cos >= 0.18 AND item IN (SELECT doc_id FROM labels WHERE quality = 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user", chunk ORDER BY round(composite, 9) DESC, round(cos, 9) DESC, item) AS r FROM scored)
SELECT "user", item, chunk, CAST(r AS INTEGER) AS rank_in_chunk, round(composite, 6) AS composite, CASE WHEN cos >= 0.30 THEN 'B' ELSE 'C' END AS tier
FROM ranked WHERE r <= CASE chunk WHEN 'recent' THEN 120 WHEN 'mid' THEN 60 ELSE 20 END"""


def queue_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Users with three phrases: auto mode fuses the ranks of cosine, facets and phrases."""
    pairs = ranking.pairs(_items(spark, d).drop("label", "year"), _users(spark, d, 3))
    return _shown(ranking.cut(ranking.score(_with_facets(pairs, bags(spark, d), F.col("user") % 2).drop("tags"), "auto")))


def tier_percentile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("item"), F.col("embedding")[0].cast("double").alias("score"))
    return e.select("label", "item", S.percentile_tier("score", "score", "label").alias("tier"))


TIER_PERCENTILE = """SELECT label, vec_id AS item, CASE WHEN s <= 0.05 AND x >= 0.30 THEN 'S' WHEN s <= 0.20 THEN 'A' WHEN s <= 0.50 THEN 'B' ELSE 'C' END AS tier
FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY x DESC) / count(*) OVER (PARTITION BY label) AS s FROM (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings))"""


def quota_cap(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("user")).agg(F.count("*").alias("n"))
    mix = F.create_map(F.lit("recent"), (F.col("n") * 10).cast("int"), F.lit("mid"), (F.col("n") * 5).cast("int"), F.lit("classic"), F.lit(1))
    return ranking.quotas(users, mix)


QUOTA_CAP = """WITH u AS (SELECT user_id AS "user", count(*) AS n FROM events GROUP BY 1),
m AS (SELECT "user", n, unnest(['recent', 'mid', 'classic']) AS chunk, unnest([n * 10, n * 5, 1]) AS q FROM u)
SELECT "user", chunk, CAST(CASE WHEN n * 15 + 1 > 1000 THEN greatest(1, floor(q * 1000 / (n * 15 + 1))) ELSE q END AS INTEGER) AS quota FROM m"""


def serve_next(spark: SparkSession, d: str) -> DataFrame:
    """Three next items for each user of the linear queue: unanswered and not labelled toxic."""
    queue = queue_linear(spark, d)
    done = answers(spark, d).select((F.col("user") % 10).alias("user"), "item").distinct()
    out = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item"))
    return ranking.serve(queue, done, out, 3).select("user", "item", "chunk", "composite", "place")


SERVE_NEXT = f"""WITH queue AS ({QUEUE_LINEAR}), {ANSWERS},
open AS (SELECT * FROM queue q WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a."user" % 10 = q."user" AND a.item = q.item) AND item NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY CASE chunk WHEN 'recent' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, composite DESC, rank_in_chunk, item) AS place FROM open)
SELECT "user", item, chunk, composite, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3"""


#: Weights of the facet codes of the even and of the odd users.
PREFS = {0: {"focus": {"IDI": 0.9, "CLO": 0.4}, "method": {"ER": 0.6, "ING": 1.0}}, 1: {"method": {"ER": 1.0}, "subj": {"CHE": 0.8}}}


def _prefs(kind) -> Column:
    """Map dim -> map code -> weight by 0 or 1."""
    as_map = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), as_map(v) if isinstance(v, dict) else F.lit(v))])
    return F.when(kind == 0, as_map(PREFS[0])).otherwise(as_map(PREFS[1]))


def _combos() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r).alias("role"), F.array(*map(F.lit, c)).alias("codes")) for i, r, c in COMBOS])


def _with_facets(pairs: DataFrame, tags: DataFrame, kind) -> DataFrame:
    """Adds tags, dim and n_combos to pairs."""
    met = pairs.join(tags.select(F.col("doc_id").alias("item"), "tags"), "item", "left").withColumn("prefs", _prefs(kind))
    bag = F.coalesce(F.flatten(F.map_values("tags")), F.array().cast("array<string>"))
    return met.withColumns({"dim": S.dim_score("tags", "prefs"), "n_combos": F.size(S.combo_hits(bag, _combos(), S.pref_codes("prefs")))}).drop("prefs")


def _facet_queue(spark: SparkSession, d: str) -> DataFrame:
    users = ranking.centroids(table(spark, d, "embeddings"), "label").withColumnRenamed("label", "user")
    pairs = ranking.pair_up(_items(spark, d).drop("label", "text"), users).withColumn("cos", S.cosine("embedding", "query")).drop("embedding", "query")
    return ranking.cut(ranking.score(_with_facets(pairs, bags(spark, d), F.col("user") % 2), "plain"))


def queue_facets(spark: SparkSession, d: str) -> DataFrame:
    """Cosine, facet score and combos of users without phrases; absolute tiers."""
    q = _facet_queue(spark, d)
    return q.select("user", "item", "chunk", "rank_in_chunk", F.round("dim", 6).alias("dim"), "n_combos", F.round("composite", 6).alias("composite"), S.absolute_tier("cos", "dim", "n_combos").alias("tier"))


_VALUES = ", ".join(f"({k}, '{dim}', '{code}', {w})" for k, v in PREFS.items() for dim, codes in v.items() for code, w in codes.items())
_CODES = {k: "[" + ", ".join(f"'{c}'" for codes in v.values() for c in codes) + "]" for k, v in PREFS.items()}


def _sql_facets(kind: str, pairs: str = "cosines") -> str:
    """CTEs facets (item, user, dim) and combos (item, user, n) of the pairs, by the kind of a user's weights."""
    wanted = "[" + ", ".join(f"{{'codes': {c}}}" for _, r, c in COMBOS if r != "guard") + "]"
    return f""",
tg AS (SELECT doc_id AS item, dim, code FROM tags WHERE r <= 3), bag AS (SELECT item, list(code) AS bag FROM tg GROUP BY item),
pw AS (SELECT kind, dim, code, CAST(w AS DOUBLE) AS w FROM (VALUES {_VALUES}) v(kind, dim, code, w)),
best AS (SELECT c.item, c."user", p.dim, max(CASE WHEN t.code IS NULL THEN 0 ELSE p.w END) AS b FROM {pairs} c JOIN pw p ON p.kind = {kind} LEFT JOIN tg t ON t.item = c.item AND t.dim = p.dim AND t.code = p.code GROUP BY ALL),
facets AS (SELECT item, "user", sum(b) / count(*) AS dim FROM best GROUP BY ALL),
combos AS (SELECT c.item, c."user", len(list_filter({wanted}, lambda x: list_has_all(bag, x.codes) AND list_has_any(x.codes, CASE WHEN {kind} = 0 THEN {_CODES[0]} ELSE {_CODES[1]} END))) AS n FROM {pairs} c JOIN bag USING (item))"""


ABSOLUTE = "CASE WHEN cos >= 0.40 AND dim >= 0.50 AND n_combos >= 1 THEN 'S' WHEN (cos >= 0.40 AND dim >= 0.30) OR (cos >= 0.30 AND dim >= 0.60) THEN 'A' WHEN cos >= 0.30 THEN 'B' ELSE 'C' END"
SQL_FACET_QUEUE = SQL_ITEMS + f", {DIM_SQL}" + _sql_facets('(c."user" % 2)') + """,
scored AS (SELECT c.item, c."user", c.chunk, c.cos, f.dim, CAST(coalesce(n, 0) AS INTEGER) AS n_combos, 0.55 * greatest(0, cos) + 0.30 * dim + least(0.15, 0.05 * coalesce(n, 0)) AS composite
  FROM cosines c JOIN facets f USING (item, "user") LEFT JOIN combos USING (item, "user") WHERE cos >= 0.18),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user", chunk ORDER BY round(composite, 9) DESC, round(cos, 9) DESC, item) AS rank_in_chunk FROM scored),
kept AS (SELECT * FROM ranked WHERE rank_in_chunk <= CASE chunk WHEN 'recent' THEN 120 WHEN 'mid' THEN 60 ELSE 20 END)"""
QUEUE_FACETS = SQL_FACET_QUEUE + f"""
SELECT "user", item, chunk, CAST(rank_in_chunk AS INTEGER) AS rank_in_chunk, round(dim, 6) AS dim, n_combos, round(composite, 6) AS composite, {ABSOLUTE} AS tier FROM kept"""


def queue_facets_linear(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, facets and combos together; tiers by rank."""
    pairs = ranking.pairs(_items(spark, d).drop("label", "year"), _users(spark, d))
    return _shown(ranking.cut(ranking.score(_with_facets(pairs, bags(spark, d), F.col("user") % 2), "phrases")))


QUEUE_FACETS_LINEAR = SQL_ITEMS + SQL_KW.replace("{k}", "15") + f", {DIM_SQL}" + _sql_facets('(c."user" % 2)') + """,
raw AS (SELECT c.item, c.chunk, c."user", cos, greatest(0, cos) AS c, coalesce(tanh(raw_kw / 25), 0) AS k, dim, least(0.15, 0.05 * coalesce(n, 0)) AS bonus
  FROM cosines c LEFT JOIN kw USING (item, "user") JOIN facets USING (item, "user") LEFT JOIN combos USING (item, "user")),
scored AS (SELECT item, chunk, "user", cos, (1 - exp(-3 * greatest(c, k))) * (0.45 * c + 0.20 * dim + 0.30 * k + bonus) AS composite FROM raw WHERE NOT (c < 0.18 AND k < 0.20))""" + SQL_CUT


QUEUE_RRF = SQL_ITEMS + SQL_KW.replace("{k}", "3") + f", {DIM_SQL}" + _sql_facets('(c."user" % 2)') + """,
raw AS (SELECT c.item, chunk, c."user", cos, coalesce(raw_kw, 0) AS raw_kw, f.dim FROM cosines c LEFT JOIN kw USING (item, "user") JOIN facets f USING (item, "user")),
ranks AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(cos, 9) DESC, item) AS a, row_number() OVER (PARTITION BY "user" ORDER BY round(dim, 9) DESC, item) AS b,
    row_number() OVER (PARTITION BY "user" ORDER BY round(raw_kw, 9) DESC, item) AS c FROM raw),
scored AS (SELECT *, (1 / (60 + a) + 1 / (60 + b) + 1 / (60 + c)) * 60 / 3 AS composite FROM ranks)""" + SQL_CUT


def explain_signals(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for an item: phrases of the user in it, combos of its facets, and a high cosine if neither does."""
    pairs = _with_facets(ranking.pairs(_items(spark, d).drop("label", "year"), _users(spark, d, 3)), bags(spark, d), F.col("user") % 2)
    bag = F.coalesce(F.flatten(F.map_values("tags")), F.array().cast("array<string>"))
    scored = ranking.score(pairs.withColumn("combos", S.combo_hits(bag, _combos(), S.pref_codes(_prefs(F.col("user") % 2)))), "phrases")
    return scored.select("user", "item", F.array_join(S.signals("matched", "combos", F.col("cos")), ",").alias("signals"), F.size("matched").alias("n_matched"), F.size("combos").alias("n_combos"))


EXPLAIN_SIGNALS = SQL_ITEMS + SQL_KW.replace("{k}", "3") + f", {DIM_SQL}" + _sql_facets('(c."user" % 2)') + """,
m AS (SELECT c.item, c."user", CAST(count(t.token) AS INTEGER) AS n_matched FROM cosines c LEFT JOIN top t ON t.label = c."user" AND t.r <= 3 AND contains(lower(c.text), t.token) GROUP BY ALL),
raw AS (SELECT item, "user", cos, greatest(0, cos) AS c, coalesce(tanh(raw_kw / 25), 0) AS k FROM cosines LEFT JOIN kw USING (item, "user"))
SELECT item, "user", CASE WHEN n_matched > 0 AND coalesce(n, 0) > 0 THEN 'kw,combo' WHEN n_matched > 0 THEN 'kw' WHEN coalesce(n, 0) > 0 THEN 'combo' WHEN cos >= 0.40 THEN 'cos' ELSE '' END AS signals, n_matched, CAST(coalesce(n, 0) AS INTEGER) AS n_combos
FROM raw JOIN m USING (item, "user") LEFT JOIN combos USING (item, "user") WHERE NOT (c < 0.18 AND k < 0.20)"""


def serve_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Three next items of the stored facet queue by the latest weights: every user's newest profile that has any."""
    queue = _facet_queue(spark, d).select("user", "item", "chunk", "rank_in_chunk", "cos", "tags")
    users = table(spark, d, "embeddings").select(F.col("label").alias("user")).distinct()
    versions = users.select("user", F.explode(F.array(*map(F.lit, (1, 2)))).alias("version"))
    kept = F.when(F.col("version") == 1, _prefs(F.col("user") % 2)).when(F.col("user") % 3 != 0, _prefs((F.col("user") + 1) % 2))
    latest = feedback.latest(versions.withColumn("prefs", kept).where(F.col("prefs").isNotNull()), ["user"], ["version"], ["prefs"])
    fresh = ranking.rerank(queue, latest, _combos())
    none = users.select("user", F.lit(None).cast("long").alias("item")).limit(0)
    out = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item"))
    return ranking.serve(fresh, none, out, 3).select("user", "item", "chunk", F.round("composite", 6).alias("composite"), "tier", "place")


SERVE_FRESH = SQL_FACET_QUEUE + _sql_facets('(CASE WHEN c."user" % 3 = 0 THEN c."user" % 2 ELSE (c."user" + 1) % 2 END)', "kept").replace("tg AS", "tg2 AS").replace("bag AS", "bag2 AS").replace("pw AS", "pw2 AS").replace("best AS", "best2 AS").replace("facets AS", "facets2 AS").replace("combos AS", "combos2 AS").replace("FROM best ", "FROM best2 ") + f""",
fresh AS (SELECT k."user", k.item, chunk, rank_in_chunk, cos, f.dim, CAST(coalesce(c.n, 0) AS INTEGER) AS n_combos, 0.55 * greatest(0, cos) + 0.30 * f.dim + least(0.15, 0.05 * coalesce(c.n, 0)) AS composite
  FROM kept k JOIN facets2 f USING (item, "user") LEFT JOIN combos2 c USING (item, "user") WHERE k.item NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY CASE chunk WHEN 'recent' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, round(composite, 9) DESC, rank_in_chunk, item) AS place FROM fresh)
SELECT "user", item, chunk, round(composite, 6) AS composite, {ABSOLUTE} AS tier, CAST(place AS INTEGER) AS place FROM r2 WHERE place <= 3"""


def weighted_query_vector(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 4)
    mean = ranking.centroids(e, "label", weight="w")
    return mean.select("label", F.posexplode("query").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


WEIGHTED_QUERY_VECTOR = """WITH f AS (SELECT label, vec_id % 4 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 4 > 0)
SELECT label, CAST(i AS INTEGER) AS i, round(sum(w * CAST(x AS DOUBLE)) / sum(w), 6) AS x FROM f GROUP BY label, i"""


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest items of each centroid: a top-k report."""
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    pairs = ranking.pair_up(items, ranking.centroids(table(spark, d, "embeddings"), "label").withColumnRenamed("label", "user"))
    near = pairs.select("user", "item", F.round(S.cosine("embedding", "query"), 6).alias("cos"))
    w = Window.partitionBy("user").orderBy(F.desc("cos"), "item")
    return near.withColumn("r", F.row_number().over(w)).where("r <= 10")


COSINE_TOPK = """WITH flat AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label AS "user", list(x ORDER BY i) AS query FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM flat GROUP BY label, i) GROUP BY label),
c AS (SELECT "user", vec_id AS item, round(list_cosine_similarity([CAST(x AS DOUBLE) FOR x IN embedding], query), 6) AS cos FROM embeddings, mean)
SELECT "user", item, cos, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY cos DESC, item) AS r FROM c) WHERE r <= 10"""


def carryover(spark: SparkSession, d: str) -> DataFrame:
    """Best part by unit with carry-over ranks."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("unit"), (F.col("p_size") % 10).alias("composite"), (F.col("p_retailprice")).alias("mean_score"))
    return ranking.carryover(p).select("unit", "item", "place", "role")


CARRYOVER = """SELECT p_brand AS unit, p_partkey AS item, CAST(place AS INTEGER) AS place, CASE WHEN place > 1 THEN 'carryover' WHEN p_size % 10 >= 7 THEN 'top' ELSE 'below_threshold' END AS role
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 10 DESC, p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5"""


def replace_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue by user after the even users' parts were rebuilt."""
    from folioflow.operators.merge import replace_groups

    a = answers(spark, d).select("user", "item", "choice").distinct()
    return replace_groups(a, a.where("user % 2 = 0 AND item < 50").withColumn("choice", F.lit("rebuilt")).distinct(), "user")


REPLACE_QUEUE = f"""WITH {ANSWERS}, n AS (SELECT DISTINCT "user", item, 'rebuilt' AS choice FROM answers WHERE "user" % 2 = 0 AND item < 50)
SELECT DISTINCT "user", item, choice FROM answers WHERE "user" NOT IN (SELECT "user" FROM n) UNION ALL SELECT * FROM n"""


QUERIES = {f.__name__: f for f in (queue_linear, queue_no_fingerprint, queue_rrf, queue_facets, queue_facets_linear, serve_fresh, tier_percentile, quota_cap, serve_next, explain_signals, weighted_query_vector, cosine_topk, carryover, replace_queue)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES}
