"""Ranked queues: scores of all items for all users, cut by age band, and what is served next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions import scoring as S
from folioflow.functions.text import token_count
from folioflow.operators.phrases import phrase_counts
from folioflow.sources.scratch import written

#: Users whose vectors and phrases go to every task at once; more are taken in blocks of this size.
BLOCK_USERS = 500
#: Rows of a range of a distributed rank: their number follows the rows.
RANK_ROWS = 500_000


def centroids(vectors: DataFrame, by: str, vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """(by, query): weighted mean vector of each group; rows without weight don't count."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = vectors.where(w > 0).select(by, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(by, "i").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query"))


def candidates(items: DataFrame, verdicts: DataFrame, vectors: DataFrame, key: str = "canonical_id") -> DataFrame:
    """Items with a relevant verdict and a vector; a null verdict counts as relevant, a missing row does not."""
    relevant = verdicts.where(F.coalesce("is_lab_relevant", F.lit(True))).select(key)
    return items.join(relevant, key, "left_semi").join(vectors, key)


def _blocks(users: DataFrame, block: int) -> list[DataFrame]:
    """users in parts of about `block`. They are written once, as every part would work them out anew."""
    users = written(users, "users")
    blocks = max(1, -(-users.count() // block))
    return [users if blocks == 1 else users.where(F.pmod(F.xxhash64("user"), F.lit(blocks)) == b) for b in range(blocks)]


def pair_up(items: DataFrame, users: DataFrame, block: int = BLOCK_USERS) -> DataFrame:
    """All items for all users: the query set, in blocks, against all rows; a block of users goes to every task."""
    return reduce(DataFrame.unionByName, (items.join(F.broadcast(u)) for u in _blocks(users, block)))


def with_counts(items: DataFrame, users: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(items with tf and n_words instead of text, users with places): how often each phrase of any user stands in a text, by one scan of each text.

    tf has a place for each distinct phrase; places are those of a user's own phrases. What is crossed
    with the users then carries numbers, never texts. users are a block, so their phrases are bounded.
    """
    listed = [r[0] for r in users.select(F.explode("phrases.phrase").alias("p")).where("p IS NOT NULL").distinct().orderBy("p").collect()]
    known = F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")
    place = users.withColumn("places", F.transform("phrases", lambda p: F.array_position(known, p["phrase"]).cast("int")))
    return phrase_counts(items.withColumn("n_words", token_count(text)), listed, text), place


def keyword_score(tf="tf", phrases="phrases", places="places", n_words="n_words") -> Column:
    """BM25 of a pair from the counts of with_counts()."""
    both = F.zip_with(phrases, places, lambda p, i: F.struct(p["score"].alias("score"), F.get(tf, i - 1).alias("tf")))
    norm = 1 - V.BM25_B + V.BM25_B * F.col(n_words) / V.BM25_AVG_LENGTH
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x["score"] * (x["tf"] * (V.BM25_K1 + 1) / (x["tf"] + V.BM25_K1 * norm)))


def pairs(items: DataFrame, users: DataFrame, block: int = BLOCK_USERS) -> DataFrame:
    """All pairs with cos and raw_kw: items have item, text, embedding; users have user, query, phrases. matched: the user's phrases in the text, which stays behind."""
    # A block counts its own phrases only, which bounds the width of tf.
    counted = (with_counts(items, u) for u in _blocks(users, block))
    met = reduce(DataFrame.unionByName, (c.join(F.broadcast(placed)) for c, placed in counted))
    matched = F.transform(F.filter(F.zip_with("phrases", "places", lambda p, i: F.struct(p["phrase"].alias("phrase"), F.get("tf", i - 1).alias("n"))), lambda x: x["n"] > 0), lambda x: x["phrase"])
    return met.withColumns({"cos": S.cosine("embedding", "query"), "raw_kw": keyword_score(), "matched": matched}).drop("embedding", "query", "tf", "places", "n_words")


def score(scored: DataFrame, mode: str = "phrases") -> DataFrame:
    """Adds composite to pairs with cos, raw_kw, phrases, dim, n_combos (plain needs neither raw_kw nor phrases).

    cos and raw_kw are worked out of embedding, query, text and phrases where a pair does not have them.

    mode: plain (no phrases), phrases or rrf (ranks of the three signals fused); auto takes rrf for users
    with one to three phrases, plain for those with none. Floors differ: plain drops low cosines, phrases
    only those that have no phrase either, rrf none.
    """
    if "cos" not in scored.columns:
        scored = scored.withColumn("cos", S.cosine("embedding", "query"))
    if "raw_kw" not in scored.columns and mode != "plain":
        scored = scored.withColumn("raw_kw", S.bm25(F.lower("text"), "phrases"))
    low = F.greatest("cos", F.lit(0.0)) < V.COS_FLOOR
    plain = lambda df: df.where(~low).withColumn("composite", S.composite_plain("cos", "dim", "n_combos"))
    phrases = lambda df: df.where(~(low & (S.kw_norm("raw_kw") < V.KW_FLOOR))).withColumn("composite", S.composite_phrases("cos", "dim", "n_combos", "raw_kw"))
    if mode == "plain":
        return plain(scored)
    if mode == "phrases":
        return phrases(scored)
    if mode == "rrf":
        return fuse(scored)
    n = F.size("phrases")
    parts = fuse(scored.where(n.between(1, V.RRF_PHRASES))), plain(scored.where(n < 1)), phrases(scored.where(n > V.RRF_PHRASES))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ranked(df: DataFrame, by: str, order: list[Column], name: str, parts: int) -> DataFrame:
    """df with `name`, the place of each row among those of its group: a group's rows are sorted by `parts` tasks.

    Rows are dealt out by ranges of (by, *order), each range numbers its own rows, and the numbers of rows
    in the ranges before are added. The ranges are written, as sampling them again could move their bounds.
    """
    dealt = df.repartitionByRange(parts, F.col(by), *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    counts = dealt.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    local = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
    return dealt.withColumn("_local", local).join(offsets, [by, "_part"]).withColumn(name, (F.col("_local") + F.col("_before")).cast("int")).drop("_part", "_local", "_before")


def fuse(scored: DataFrame) -> DataFrame:
    """Adds composite by the ranks of the three signals. phrases and n_combos, which it does not need, go; pairs are written, as finding ranges reads them again."""
    out = written(scored.drop("phrases", "n_combos"), "pairs")
    parts = max(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-out.count() // RANK_ROWS))
    names = []
    for name, c in (("cos", "cos"), ("dim", "dim"), ("kw", "raw_kw")):
        names.append(f"rank_{name}")
        out = ranked(out, "user", [F.desc(F.round(c, 9)), F.col("item")], names[-1], parts)
    return out.withColumn("composite", S.rrf(*names))


def quotas(users: DataFrame, mix: Column, cap: int = V.QUEUE_CAP) -> DataFrame:
    """(user, chunk, quota) of a map chunk -> number; mixes above the cap shrink in proportion, but not below one."""
    total = F.aggregate(F.map_values(mix), F.lit(0), lambda s, x: s + x)
    each = users.select("user", F.explode(mix).alias("chunk", "n"), total.alias("total"))
    return each.select("user", "chunk", F.when(F.col("total") > cap, F.greatest(F.lit(1), F.floor(F.col("n") * cap / F.col("total")).cast("int"))).otherwise(F.col("n")).alias("quota"))


def cut(scored: DataFrame, quota: Column | None = None) -> DataFrame:
    """Top rows by user and age band, then the tier by rank within the cut. Scores are compared to nine places."""
    w = Window.partitionBy("user", "chunk").orderBy(F.desc(F.round("composite", 9)), F.desc(F.round("cos", 9)), "item")
    numbered = scored.withColumn("rank_in_chunk", F.row_number().over(w))
    if quota is None:
        # The plain bound lets every task drop what cannot rank before the shuffle.
        numbered = numbered.where(F.col("rank_in_chunk") <= max(V.CHUNK_MIX.values()))
        quota = F.coalesce(*[F.when(F.col("chunk") == c, n) for c, n in V.CHUNK_MIX.items()])
    kept = numbered.where(F.col("rank_in_chunk") <= quota)
    return kept.withColumn("tier", S.percentile_tier(F.round("composite", 9), "cos", "user", "chunk"))


def serve(queue: DataFrame, answered: DataFrame, out_of_scope: DataFrame, k: int = 1) -> DataFrame:
    """Next k items of every user: unanswered, in scope, by age band, fresh composite, stored rank."""
    open_ = queue.join(answered.select("user", "item"), ["user", "item"], "left_anti").join(out_of_scope.select("item"), "item", "left_anti")
    order = F.coalesce(*[F.when(F.col("chunk") == c, i) for i, (c, *_) in enumerate(V.CHUNKS)], F.lit(99))
    w = Window.partitionBy("user").orderBy(order, F.desc(F.round("composite", 9)), F.coalesce("rank_in_chunk", F.lit(9999)), "item")
    return open_.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rerank(queue: DataFrame, prefs: DataFrame, combos: Column) -> DataFrame:
    """Stored queue rows scored anew with the latest preferences: composite, tier and the three signals behind them.

    queue has user, item, cos and tags (map dim -> codes); prefs has user and prefs (map dim -> map code -> weight);
    a user without any keeps the cosine alone. The stored rank stays for ties.
    """
    fresh = queue.drop("dim", "n_combos", "composite", "tier").join(prefs.select("user", "prefs"), "user", "left")
    bag = F.coalesce(F.flatten(F.map_values("tags")), F.array().cast("array<string>"))
    fresh = fresh.withColumn("dim", F.coalesce(S.dim_score("tags", "prefs"), F.lit(0.0))).withColumn("n_combos", F.coalesce(F.size(S.combo_hits(bag, combos, S.pref_codes("prefs"))), F.lit(0)))
    fresh = fresh.withColumn("n_combos", F.greatest("n_combos", F.lit(0)))
    return fresh.withColumn("composite", S.composite_plain("cos", "dim", "n_combos")).withColumn("tier", S.absolute_tier("cos", "dim", "n_combos")).drop("prefs")


def carryover(scored: DataFrame, least: int = 7) -> DataFrame:
    """Per unit the best item if it reaches `least`, with the next four as carry-over; else a reason."""
    w = Window.partitionBy("unit").orderBy(F.desc("composite"), F.desc("mean_score"), "item")
    ranked = scored.withColumn("place", F.row_number().over(w)).where("place <= 5")
    role = F.when(F.col("place") > 1, "carryover").when(F.col("composite") >= least, "top").otherwise("below_threshold")
    return ranked.withColumn("role", role)
