"""Scores of an item for a user, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from folioflow.functions import fixed_values as V
from folioflow.functions.text import count_of, token_count


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 where either vector is zero or missing."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def bm25(text, phrases) -> Column:
    """Phrases are structs (phrase, score); the score stands for the inverse document frequency."""
    text = _c(text)
    norm = 1 - V.BM25_B + V.BM25_B * token_count(text) / V.BM25_AVG_LENGTH

    def part(p: Column) -> Column:
        tf = count_of(text, p["phrase"])
        return p["score"] * (tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * norm))

    return F.aggregate(F.transform(_c(phrases), part), F.lit(0.0), lambda s, x: s + x)


def kw_norm(raw) -> Column:
    return F.tanh(_c(raw) / V.KW_SCALE)


def bonus(n_combos) -> Column:
    return F.least(F.lit(V.COMBO_MOST), _c(n_combos) * V.COMBO_STEP)


def composite_plain(cos, dim, n_combos) -> Column:
    return V.W_COS * F.greatest(F.lit(0.0), _c(cos)) + V.W_DIM * _c(dim) + bonus(n_combos)


def composite_phrases(cos, dim, n_combos, raw_kw) -> Column:
    c, k = F.greatest(F.lit(0.0), _c(cos)), kw_norm(raw_kw)
    base = V.W_COS_PHRASES * c + V.W_DIM_PHRASES * _c(dim) + V.W_KW * k + bonus(n_combos)
    return (1 - F.exp(-V.SOFT_FLOOR * F.greatest(c, k))) * base


def rrf(*ranks) -> Column:
    total = sum((1 / (V.RRF_K + _c(r)) for r in ranks), F.lit(0.0))
    return total * V.RRF_K / len(ranks)


def absolute_tier(cos, dim, n_combos) -> Column:
    cos, dim, n = _c(cos), _c(dim), _c(n_combos)
    return (
        F.when((cos >= 0.40) & (dim >= 0.50) & (n >= 1), "S")
        .when(((cos >= 0.40) & (dim >= 0.30)) | ((cos >= 0.30) & (dim >= 0.60)), "A")
        .when(cos >= 0.30, "B")
        .otherwise("C")
    )


def percentile_tier(score, cos, *partition: str) -> Column:
    """Rank by score over the number of rows of the cut; the best tier also needs its cosine."""
    w = Window.partitionBy(*partition)
    share = F.rank().over(w.orderBy(_c(score).desc())) / F.count("*").over(w)
    return F.when((share <= 0.05) & (_c(cos) >= 0.30), "S").when(share <= 0.20, "A").when(share <= 0.50, "B").otherwise("C")


def dim_score(tags, prefs, dims: list[str] = V.DIMS) -> Column:
    """tags: map dim -> codes; prefs: map dim -> map code -> weight. Mean over the dims that have weights."""
    tags, prefs = _c(tags), _c(prefs)

    def best_of(d: str) -> Column:
        return F.coalesce(F.array_max(F.transform(tags[d], lambda c: F.coalesce(prefs[d][c], F.lit(0.0)))), F.lit(0.0))

    total, n = F.lit(0.0), F.lit(0)
    for d in dims:
        has, best = F.coalesce(F.size(prefs[d]) > 0, F.lit(False)), best_of(d)
        total = total + F.when(has, best).otherwise(0.0)
        n = n + has.cast("int")
    return F.when(n > 0, total / n).otherwise(0.0)


def pref_codes(prefs, combos=None, dims: list[str] = V.DIMS) -> Column:
    prefs = _c(prefs)
    none = F.array().cast("array<string>")
    sets = [F.coalesce(F.map_keys(F.map_filter(prefs[d], lambda k, v: v > 0)), none) for d in dims]
    return F.array_distinct(F.concat(*sets, F.coalesce(F.flatten(combos), none) if combos is not None else none))


def combo_hits(bag, combos, wanted=None) -> Column:
    """Ids of the combos (structs id, role, codes) whose codes are all in the bag and touch the wanted ones."""
    bag = _c(bag)

    def ok(c: Column) -> Column:
        hit = (F.coalesce(c["role"], F.lit("relevance")) != "guard") & (F.size(c["codes"]) > 0) & (F.size(F.array_except(c["codes"], bag)) == 0)
        return hit & F.arrays_overlap(c["codes"], _c(wanted)) if wanted is not None else hit

    return F.transform(F.filter(_c(combos), ok), lambda c: c["id"])


def signals(kw, combos, cos) -> Column:
    """What explains a row: matched phrases, then combos, then a high cosine only if there is nothing else."""
    kw, combos, cos = _c(kw), _c(combos), _c(cos)
    some = (F.size(kw) > 0) | (F.size(combos) > 0)
    return F.array_compact(F.array(F.when(F.size(kw) > 0, "kw"), F.when(F.size(combos) > 0, "combo"), F.when(~some & (cos >= 0.40), "cos")))
