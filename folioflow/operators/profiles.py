"""Whom to recommend to: active projects, their texts, fingerprints, and where preferences come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions.rounding import half_even
from folioflow.functions.json_values import string_leaves
from folioflow.functions.text import NO_GIST, doi_normalize, gist, keyword_tokens, salvage_tokens
from folioflow.operators.phrases import CHANNEL_WEIGHTS, channel_hits
from folioflow.sources.scratch import written

PHASES = ["data_collection", "analysis", "manuscript_draft"]  # fixed values
SURE = 0.7
#: Phrases up to which a fingerprint is filled up by salvage, the most it keeps, and the most novel terms.
FEW_PHRASES, MOST_PHRASES, MOST_NOVEL = 3, 50, 30


def active_projects(projects: DataFrame, phases: list[str] = PHASES, least: float = SURE) -> DataFrame:
    """Projects in one of the phases that are sure enough; a null confidence is not."""
    return projects.where(F.col("phase").isin(phases) & (F.col("confidence_avg") >= least))


def project_weights(weights, n) -> Column:
    """n weights that add up to 1; uniform ones where there are not n of them, one is negative or null, or all are 0."""
    w = F.col(weights) if isinstance(weights, str) else weights
    n = F.col(n) if isinstance(n, str) else n
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    fit = F.coalesce((F.size(w) == n) & F.forall(w, lambda x: x >= 0) & (total > 0), F.lit(False))
    uniform = F.when(n > 0, F.array_repeat(F.lit(1.0) / n, n.cast("int"))).otherwise(F.array().cast("array<double>"))
    return F.when(fit, F.transform(w, lambda x: x / total)).otherwise(uniform)


def channel_text(*parts) -> Column:
    """Non-blank parts joined by a middle dot."""
    return _joined(" · ", parts)


def interest_text(*parts) -> Column:
    """Non-blank parts, one a line."""
    return _joined("\n", parts)


def _joined(by: str, parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(by, *[F.when(F.trim(c) != "", F.trim(c)) for c in cols])


def harvest_dois(studies) -> Column:
    """Normalised DOIs of a JSON list whose entries are objects with a doi or bare strings; other entries and blanks go."""
    items = F.from_json(studies, "array<string>")
    raw = F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.doi")).otherwise(x))
    return F.coalesce(F.filter(F.transform(raw, doi_normalize), lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))


def fingerprint(hits: DataFrame, salvage: DataFrame, few: int = FEW_PHRASES, most: int = MOST_PHRASES) -> DataFrame:
    """(user, phrase, score, rank): lexicon hits; users with few of them get salvaged phrases that they lack, in any case of letters."""
    low = F.lower("phrase")
    n = hits.groupBy("user").agg(F.count("*").alias("n"))
    poor = salvage.join(n, "user", "left").where(F.coalesce("n", F.lit(0)) <= few).drop("n")
    more = poor.withColumn("_low", low).join(hits.select("user", low.alias("_low")), ["user", "_low"], "left_anti").drop("_low")
    both = hits.select("user", "phrase", "score", F.lit(0).alias("pass")).unionByName(more.select("user", "phrase", "score", F.lit(1).alias("pass")))
    w = Window.partitionBy("user").orderBy("pass", F.desc("score"), "phrase")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


# --- fixed values: keywords of a topic bundle, and words that its gist is made of at most --------------
BUNDLE_KEYWORDS, GIST_PARTS = 25, 60


def topic_bundles(units: DataFrame, projects: DataFrame, stop: list[str], most: int = BUNDLE_KEYWORDS) -> DataFrame:
    """(unit_id, members, n_projects, keywords, anchor_dois, gist) of units with projects.

    units: unit_id, member, place; projects: init, project_slug, title and JSON texts purpose, variables, graph, background. Keywords
    are the commonest tokens of questions, hypotheses, variables and shared paradigms, of equal ones the first to
    appear, by members in their order, then by slug. Units without a project are left out.
    """
    p = projects.withColumnRenamed("init", "member").join(units.select("unit_id", "member", "place"), "member")
    leaves = [string_leaves(F.get_json_object(c, f"$.{f}")) for c, f in (("variables", "independent_vars"), ("variables", "dependent_vars"), ("graph", "shared_paradigm_with"))]
    texts = F.concat(F.array_compact(F.array(F.get_json_object("purpose", "$.research_question"), F.get_json_object("purpose", "$.hypothesis"))), *leaves)
    tokens = F.flatten(F.transform(texts, lambda t: keyword_tokens(t, stop)))
    each = p.select("unit_id", "place", "project_slug", F.posexplode(tokens).alias("at", "token"))
    counted = each.groupBy("unit_id", "token").agg(F.count("*").alias("n"), F.min(F.struct("place", "project_slug", "at")).alias("first"))
    w = Window.partitionBy("unit_id").orderBy(F.desc("n"), "first")
    top = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    dois = p.select("unit_id", F.explode(harvest_dois(F.get_json_object("background", "$.prior_studies"))).alias("doi")).groupBy("unit_id").agg(F.sort_array(F.collect_set("doi")).alias("anchor_dois"))
    # A gist has sixty words, so the first sixty projects with a title hold it.
    w = Window.partitionBy("unit_id").orderBy("place", "project_slug")
    titled = p.select("unit_id", "place", "project_slug", F.coalesce(F.nullif("title", F.lit("")), "project_slug").alias("title"), F.coalesce(F.get_json_object("purpose", "$.research_question"), F.lit("")).alias("question"))
    early = titled.where(F.trim("title") != "").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= GIST_PARTS + 1)
    listed = early.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("_r", "title", "question"))).alias("l"))
    gists = listed.select("unit_id", gist(F.transform("l", lambda x: x["title"]), F.transform("l", lambda x: x["question"]), GIST_PARTS).alias("gist"))
    slugs = p.groupBy("unit_id").agg(F.count("*").alias("n_projects"))
    members = units.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x["member"]).alias("members"))
    none = F.array().cast("array<string>")
    out = slugs.join(members, "unit_id").join(top, "unit_id", "left").join(dois, "unit_id", "left").join(gists, "unit_id", "left")
    return out.select("unit_id", "members", "n_projects", F.coalesce("keywords", none).alias("keywords"), F.coalesce("anchor_dois", none).alias("anchor_dois"), F.coalesce("gist", F.lit(NO_GIST)).alias("gist"))


def salvage(texts: DataFrame, idf: DataFrame, weights: dict[str, float] = CHANNEL_WEIGHTS, stop: list[str] = V.SALVAGE_STOP, least: float = V.SALVAGE_IDF, top: int = V.SALVAGE_TOP) -> DataFrame:
    """(user, phrase, score, n_hits): leading tokens of a user's texts (user, channel, text) by weighted frequency times idf.

    idf has token and idf; tokens that it lacks, or that are not rare enough, go. Ties go by token.
    """
    weight = F.coalesce(*[F.when(F.col("channel") == c, F.lit(w)) for c, w in weights.items()])
    counted = texts.where(F.col("user").isNotNull()).select("user", "channel", F.explode(salvage_tokens("text", stop)).alias("token")).groupBy("user", "channel", "token").agg(F.count("*").alias("n"))
    tf = counted.groupBy("user", "token").agg(F.sum(F.col("n") * weight).alias("tf")).where("tf IS NOT NULL")
    worth = tf.join(idf.where(F.col("idf") >= least).select("token", "idf"), "token")
    scored = worth.select("user", F.col("token").alias("phrase"), half_even(F.col("tf") * F.col("idf"), 3).alias("score"), half_even("tf").cast("long").alias("n_hits"))
    w = Window.partitionBy("user").orderBy(F.desc("score"), "phrase")
    return scored.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top).drop("_rank")


def text_fingerprint(texts: DataFrame, lexicon: DataFrame, phrase_idf: DataFrame, token_idf: DataFrame, few: int = FEW_PHRASES, most: int = MOST_PHRASES) -> DataFrame:
    """(user, phrase, score, channels, n_hits, rank): the fingerprint of users' texts (user, channel, text).

    First the lexicon pass, of which the best `most` phrases stay. Users with `few` of them or fewer get salvaged tokens
    behind those, but for tokens that are among their phrases in any case of letters.
    """
    hits = channel_hits(texts, lexicon, phrase_idf)
    w = Window.partitionBy("user").orderBy(F.desc("score"), "phrase")
    kept = written(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most), "lexicon-hits")
    n = kept.groupBy("user").agg(F.count("*").alias("n"))
    poor = texts.select("user").distinct().join(n, "user", "left").where(F.coalesce("n", F.lit(0)) <= few).select("user", F.coalesce("n", F.lit(0)).alias("n"))
    more = salvage(texts.join(poor.select("user"), "user", "left_semi"), token_idf)
    fresh = more.withColumn("_low", F.lower("phrase")).join(kept.select("user", F.lower("phrase").alias("_low")), ["user", "_low"], "left_anti").drop("_low")
    placed = fresh.join(poor, "user").withColumn("rank", (F.col("n") + F.row_number().over(w)).cast("int"))
    columns = ["user", "phrase", "score", "channels", "n_hits", "rank"]
    return kept.select(*columns).unionByName(placed.withColumn("channels", F.array(F.lit(V.SALVAGE_CHANNEL))).select(*columns))


def novel_terms(phrases: DataFrame, keywords: DataFrame, most: int = MOST_NOVEL) -> DataFrame:
    """(user, phrase, place): leading phrases of a fingerprint that the taxonomy does not have as keyword, whatever the case."""
    new = phrases.withColumn("_low", F.lower("phrase")).join(keywords.select(F.lower("keyword").alias("_low")).distinct(), "_low", "left_anti")
    place = F.row_number().over(Window.partitionBy("user").orderBy("rank"))
    return new.withColumn("place", place).where(F.col("place") <= most).select("user", "phrase", "place")


def derived_prefs(tagged: DataFrame) -> DataFrame:
    """(user, prefs): map dim -> map code -> weight of tags (user, dim, code, strength), the strongest code of a dim at 1."""
    top = tagged.groupBy("user", "dim").agg(F.max("strength").alias("m"), F.collect_list(F.struct("code", "strength")).alias("c"))
    weights = F.map_from_entries(F.transform(F.array_sort("c"), lambda x: F.struct(x["code"].alias("k"), F.round(x["strength"] / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0), 3).alias("v"))))
    dims = top.select("user", "dim", weights.alias("w"))
    lists = dims.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("dim", F.map_entries("w").alias("w")))).alias("e"))
    return lists.select("user", F.map_from_entries(F.transform("e", lambda x: F.struct(x["dim"], F.map_from_entries(x["w"])))).alias("prefs"))


def preference_chain(users: DataFrame, verified: DataFrame, fingerprints: DataFrame, derived: DataFrame) -> DataFrame:
    """(user, prefs, source): the verified preferences, else those of a usable fingerprint, else derived ones, else none.

    A fingerprint with an error or without phrases is none; so are preferences that are null or empty. Of several
    rows of a user in one source the one with the largest text counts, so a user has one row.
    """
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    usable = fingerprints.where(F.col("error").isNull() & (F.size("phrases") > 0))
    out = users.select("user").distinct()
    for name, df in (("verified", verified), ("fingerprint", usable), ("auto", derived)):
        one = df.where(F.size("prefs") > 0).groupBy("user").agg(F.max_by("prefs", F.to_json("prefs")).alias(name))
        out = out.join(one, "user", "left")
    names = ["verified", "fingerprint", "auto"]
    return out.select("user", F.coalesce(*map(some, names)).alias("prefs"), F.coalesce(*[F.when(some(n).isNotNull(), n) for n in names], F.lit("none")).alias("source"))


def missing_vectors(items: DataFrame, verdicts: DataFrame, vectors: DataFrame, key: str = "canonical_id") -> DataFrame:
    """Items that no verdict calls irrelevant and that have no vector yet: what an embedding batch has to do. Items without a key have nothing to file a vector under and go."""
    out = verdicts.where(~F.coalesce("is_lab_relevant", F.lit(True))).select(key)
    return items.where(F.col(key).isNotNull()).join(out, key, "left_anti").join(vectors.select(key), key, "left_anti")


def embed(items: DataFrame, encode, text: str = "text", key: str = "canonical_id", batch: int = 16) -> DataFrame:
    """(key, embedding) by `encode`, a function of no argument that loads a model once a task and gives list of texts -> list of vectors."""

    def run(frames):
        import pandas as pd

        model = encode()
        for pdf in frames:
            texts = pdf[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.DataFrame({key: pdf[key], "embedding": [[float(x) for x in v] for v in vectors]})

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
