"""Similar titles: blocks against all pairs, copies, and what fuzzy passes and barred candidates make of them."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest

from folioflow.functions import text as X
from folioflow.operators import drafts, resolve, similar

RECORD = "canonical_id string, title_norm string, title string, year int, is_preprint boolean, abstract string, doi string, seq int"


def titles(seed, n, longest):
    """n different titles, many of them some edits away from others, of common pieces, some with characters beyond ASCII."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        t = [rng.choice("the and tion er ü 記憶 in on 7".split()) for _ in range(rng.randrange(1, longest))]
        for _ in range(4):
            out.add("".join(t))
            t = list("".join(t))
            for _ in range(rng.randrange(1, 3 + len(t) // 8)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randrange(2)] = rng.choice(["", "x", "the"])
            t = t or ["a"]
    return sorted(out - {""})


def ratio(a, b):
    return 2 * X._lcs(a, b) / (len(a) + len(b))


@pytest.mark.parametrize("least,longest", [(0.88, 12), (0.92, 150), (0.6, 20)])
def test_blocks_lose_no_pair(spark, monkeypatch, least, longest):
    monkeypatch.setattr(similar, "BLOCK_TITLES", 25)
    monkeypatch.setattr(similar, "BITS", 40)
    monkeypatch.setattr(similar, "AT_ONCE", 64)
    monkeypatch.setattr(similar, "TOGETHER", 50)
    group = lambda i: None if i % 11 == 0 else i % 2
    t = titles(5, 160, longest)
    rows = [(f"{i:03d}", x, group(i)) for i, x in enumerate(t)]
    df = spark.createDataFrame([*rows, ("none", None, 1), ("void", "", 1)], "canonical_id string, title_norm string, g int")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ratio(a[1], b[1]) >= least}
    got = [tuple(r) for r in similar.similar_pairs(df, None, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    one = [tuple(r) for r in similar.similar_pairs(df, None, least, ["g"]).collect()]
    assert sorted(one) == sorted((a, b) for a, b in want if group(int(a)) is not None and group(int(a)) == group(int(b)))
    left, right = df.where("canonical_id < '080'"), df.where("canonical_id >= '080'")
    two = [tuple(r) for r in similar.similar_pairs(left, right, least).collect()]
    assert sorted(two) == sorted((a, b) for a, b in want if a < "080" <= b)
    assert similar.similar_pairs(left.limit(0), right, least).count() == 0


def compared(monkeypatch, module):
    """Numbers of titles that similar_pairs() was given."""
    seen = []

    def counted(left, right, *more):
        seen.append(tuple(x if x is None else x.count() for x in (left, right)))
        return similar.similar_pairs(left, right, *more)

    monkeypatch.setattr(module, "similar_pairs", counted)
    return seen


def test_preprints_compare_each_title_once(spark, monkeypatch):
    t = ["thestudyofworkingmemoryinhumans", "thestudyofworkingmemoryinhuman", "onsomethingelsethatnobodyreadsatall"]
    rows = [(f"{i:04d}", t[i % 3], t[i % 3], 2000, i % 2 == 0, "x", None, 500 - i) for i in range(300)]
    seen = compared(monkeypatch, resolve)
    got = {r.alias: r.keeper for r in resolve.fuzzy_preprint(spark.createDataFrame(rows, RECORD)).collect()}
    assert seen == [(3, 3)]
    first = {k: min((r[7], r[0]) for r in rows if not r[4] and ratio(r[1], k) >= 0.88)[1] for k in t}
    want = {r[0]: first[r[1]] for r in rows if r[4]}
    assert got == want


def test_exact_lengths_in_step(monkeypatch):
    t = titles(9, 60, 60)[:60]
    sides = [similar._Titles(pd.Series(range(60)), pd.Series(t)) for _ in range(2)]
    i, j = (np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60))
    want = [X._lcs(sides[0].titles[p], sides[1].titles[q]) for p, q in zip(i, j)]
    assert similar._lcs_lengths(*sides, i, j).tolist() == want
    monkeypatch.setattr(similar, "WORDS", 3000)
    assert similar._lcs_lengths(*sides, i, j).tolist() == want


def test_barred_compares_each_title_once_and_every_title_of_a_doi(spark, monkeypatch):
    like, other = "neural coding of memory in cortex", "nothing of the kind, really"
    c = [("u", "10.1/a", other), ("u", "10.1/a", like), ("u", "10.1/b", like), ("u", "10.1/b", other), ("u", "10.1/c", other), ("v", "10.1/d", like), (None, "10.1/e", like)] * 20
    t = [("u", like.upper() + "s"), (None, like)] * 30
    seen = compared(monkeypatch, drafts)
    got = drafts.barred(spark.createDataFrame(c, "unit string, doi string, title string"), spark.createDataFrame([], "unit string, doi string"), spark.createDataFrame(t, "unit string, title string"))
    assert sorted(map(tuple, got.collect())) == [("u", "10.1/a", "title"), ("u", "10.1/b", "title")]
    assert seen == [(4, 2)]


def test_greedy_compares_each_title_of_a_year_once(spark, monkeypatch):
    # x is like y and y like z, but x is not like z; copies differ in their raw titles, which give the order.
    x, y, z = "a" * 44 + "bbbbbb", "a" * 47 + "bbb", "a" * 50
    rows = [(f"{i:03d}", k, k + "!" * (i * 7 % 40), 2010 + i % 2, False, "x", None, i) for i, k in enumerate((x, y, z, "something else") * 15)]
    seen = compared(monkeypatch, resolve)
    got = {r.alias: r.keeper for r in resolve.fuzzy_within_year(spark.createDataFrame(rows, RECORD)).collect()}
    assert seen == [(4, None)]
    want = {}
    for year in (2010, 2011):
        kept = []
        for r in sorted([r for r in rows if r[3] == year], key=lambda r: (-len(r[2]), r[0])):
            fit = next((k for k in kept if ratio(r[1], k[1]) >= 0.92), None)
            want |= {r[0]: fit[0]} if fit else {}
            kept += [] if fit else [r]
    assert got == want


def test_barred_does_not_multiply_near_copies(spark, monkeypatch):
    # 120 titles of a unit are all like one another; of `apart` the common subsequence is long enough, but not the blocks.
    monkeypatch.setattr(similar, "BLOCK_TITLES", 40)
    monkeypatch.setattr(similar, "TOGETHER", 50)
    near = [f"neural coding of memory and vision in the human cortex {i:03d}" for i in range(120)]
    apart = "ab" * 20, "ba" * 20
    rng = random.Random(4)
    c = [(u, f"10.1/{u}{i}", t) for u in "uv" for i, t in enumerate([*near[::2], apart[0], "\tsome words", "alone", *titles(7, 40, 30)])]
    t = [("u", x) for x in [*near[1::2], apart[1], " some  words\t", *(x[:-1] for x in titles(7, 40, 30))]] + [("v", "something else")]
    rng.shuffle(c)
    made = []

    def counted(*given):
        met = similar.similar_pairs(*given)
        made.append(met.groupBy("a").count().agg({"count": "max"}).first()[0])
        return met

    monkeypatch.setattr(drafts, "similar_pairs", counted)
    got = drafts.barred(spark.createDataFrame(c, "unit string, doi string, title string"), spark.createDataFrame([], "unit string, doi string"), spark.createDataFrame(t, "unit string, title string"))
    clean = lambda x: " ".join(x.lower().split())
    want = {(u, d, "title") for u, d, x in c for v, y in t if u == v and difflib.SequenceMatcher(None, clean(x), clean(y)).ratio() >= 0.9}
    assert set(map(tuple, got.collect())) == want and len(want) > 70
    # Once a block at most: 60 or so titles of the other side are in two slices, and lengths in three cells.
    assert made[0] <= 6


def test_first_confirmed_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(similar, "FIRST", 1)
    monkeypatch.setattr(similar, "TOGETHER", 20)
    monkeypatch.setattr(similar, "AT_ONCE", 64)
    t = titles(11, 150, 30)
    a, b = (pd.Series(range(len(t)))[k::2] for k in (0, 1))
    sides = a, pd.Series([t[i] for i in a]), b, pd.Series([t[i] for i in b])
    confirm = lambda x, y: (len(x) + len(y)) % 3 > 0
    every = {(x, y) for x, y in similar.similar_in_block(*sides, 0.6) if confirm(t[x], t[y])}
    got = list(similar.similar_in_block(*sides, 0.6, confirm))
    assert set(got) <= every and len(got) == len(set(x for x, _ in got))
    assert {x for x, _ in got} == {x for x, _ in every} and len(every) > len(got)
