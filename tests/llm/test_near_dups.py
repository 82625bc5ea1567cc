"""Near duplicates against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import near_dups
from folioflow.llm.wordhash import mix

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        ids[find(k)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def planted():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for n, copies, edits in ((200, 60, 6), (80, 25, 2), (300, 20, 4)):
        base = [rng.choice(words) for _ in range(n)]
        rows += [edited(rng, base, rng.randrange(edits)) for _ in range(copies)]
    chain = [rng.choice(words) for _ in range(150)]
    for k in range(12):  # each like the next, the ends unlike
        rows.append(" ".join(chain))
        chain[k * 12] = f"c{k}"
    rows += [" ".join(rng.choice(words) for _ in range(120)) for _ in range(60)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows += [shared + " " + " ".join(rng.choice(words) for _ in range(25)) for _ in range(40)]
    rows += ["a b c", "A  b\nC", "a b", "", "  ", None, "one"] + [rows[0]] * 5
    rng.shuffle(rows)
    return [(k, t, None) for k, t in enumerate(rows)]


def result(spark, rows):
    out = near_dups.near_dups(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=str)


def test_all_pairs(spark):
    rows = planted()
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", None), (7, "a b c d e f", "s"), (7, "a b c d e f", "s"), (7, "other words in here now", None), (3, None, None), (3, None, None)]
    got = result(spark, rows)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (7, 1, 7, True), (3, 0, 3, True), (3, 0, 3, True)], key=str)


def test_first_rows(spark):
    """One row of each group, whatever the ids: nulls and repeated ids included."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    groups = [make(120) for _ in range(6)]
    rows = []
    for g, words in enumerate(groups):
        rows += [(rng.choice([None, None, 1, 2, 10 * g + k]), edited(rng, words, k % 4), f"s{k % 2}") for k in range(6)]
    rows += [(50, " ".join(groups[0]), "a"), (50, " ".join(groups[1]), "a"), (50, "a text of its own is here", "a"), (None, None, "n"), (None, "", "n"), (3, " ", "n"), (3, " ", "n")]
    rows += [(70, "equal rows one two three", "e")] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, s, i, 5) for i, t, s in rows], "doc_id long, text string, source string, key long, _row_hash int")
    got = [tuple(r) for r in near_dups.first_rows(df).collect()]
    sets = [shingles(t) for _, t, *_ in got]
    assert sum(not s for s in sets) == 4  # rows without words stay
    some = [(r, s) for r, s in zip(got, sets, strict=True) if s]
    assert not [1 for k, (_, a) in enumerate(some) for _, b in some[:k] if 100 * len(a & b) >= 85 * len(a | b)]
    parts = defaultdict(list)
    for k, _, comp, _ in brute([(k, t) for k, (_, t, _) in enumerate(rows)]):
        parts[comp].append(rows[k])
    left = {(r[0], r[1]) for r, _ in some}
    for v in parts.values():
        if shingles(v[0][1]):
            least = min((x[0] for x in v if x[0] is not None), default=None)
            assert [x[0] for x in set(v) if (x[0], x[1]) in left and x[0] == least]
    assert all(r[3] == r[0] and r[4] == 5 for r in got)
    assert near_dups.first_rows(df.limit(0)).collect() == []


def test_hot_classes_are_split(spark, monkeypatch):
    from folioflow.llm import common

    calls = []

    def hot_keys(left, key, **kw):
        calls.append(out := common.hot_keys(left, key, least=3, share=100))
        return out

    monkeypatch.setattr(near_dups, "hot_keys", hot_keys)
    rows = planted()
    assert result(spark, rows) == brute(rows)
    assert any(calls)


def test_empty(spark):
    assert result(spark, []) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400))), max_size=5))
def test_parities_never_differ_in_more_bits_than_the_sets_in_shingles(pairs):
    sets = [np.array(sorted(s), dtype=np.uint64) for pair in pairs for s in pair]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = mix(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
    bits = near_dups.parities(flat, size)
    for i, (a, b) in enumerate(pairs):
        assert sum(int(x).bit_count() for x in (bits[2 * i] ^ bits[2 * i + 1]).view(np.uint64)) <= len(a ^ b)


def test_threshold_of_the_stage(spark):
    import corpus_pipeline

    assert (near_dups.least_matches(85), near_dups.least_matches(80)) == (16, 13)
    rows, likeness = [], {}
    for k, changed in enumerate([8, 9, 10, 11, 12, 15] * 5):  # with 100 shingles each: Jaccard (100 - changed) / (100 + changed)
        words = [f"d{k}w{j}" for j in range(104)]
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(words[: 104 - changed] + [f"d{k}x{j}" for j in range(changed)]), "s")]
        a, b = (shingles(t) for _, t, _ in rows[-2:])
        likeness[2 * k + 1] = len(a & b) / len(a | b)
    assert sum(0.8 <= x < 0.85 for x in likeness.values()) == 15
    docs = spark.createDataFrame(rows, SCHEMA)
    for limit, frame in ((0.8, corpus_pipeline.drop_near_dups(spark, docs, "")), (0.8, near_dups.near_dups(docs, threshold=80).where("kept")), (0.85, near_dups.near_dups(docs).where("kept"))):
        assert {r.doc_id for r in frame.collect()} == {i for i, *_ in rows} - {i for i, x in likeness.items() if x >= limit}


def phrased(seed=21, n=220):
    """Texts made of a few phrases, so that every shingle is common, and near copies of some of them."""
    rng = random.Random(seed)
    phrases = [[f"p{k}w{j}" for j in range(14)] for k in range(9)]
    rows = []
    for _ in range(n):
        rows.append([w for k in rng.sample(range(9), 4) for w in phrases[k]])
    rows += [[*rng.choice(rows)[:-1], f"own{k}"] for k in range(40)] + [[f"own{k}", *rng.choice(rows)[1:]] for k in range(40)]
    rng.shuffle(rows)
    return [(k, " ".join(t), None) for k, t in enumerate(rows)]


def test_common_shingles_meet_by_two(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "COMMON", 5)
    by_two = []
    met = near_dups.met_pairs
    monkeypatch.setattr(near_dups, "met_pairs", lambda posts, key, *a: by_two.append(key) or met(posts, key, *a))
    for rows in (phrased(), planted()):
        assert result(spark, rows) == brute(rows)
    assert "two" in by_two


def prefixes(spark, rows, comp=None):
    """What prefix_pairs() lets meet, each row being a component of its own."""
    sets = [shingles(t) for _, t, _ in rows]
    cands = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    open_ = spark.createDataFrame([(i, i, len(s)) for (i, _, _), s in zip(rows, sets, strict=True)], "id long, comp long, n long")
    return [tuple(r) for r in near_dups.prefix_pairs(open_, cands, 85)[0].collect()]


def test_two_shingles_lose_no_pair(spark, monkeypatch):
    rows = [(i, t, None) for i, t in enumerate({t for _, t, _ in phrased(22, 120)})]
    sets = [shingles(t) for _, t, _ in rows]
    want = {(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    monkeypatch.setattr(near_dups, "COMMON", 4)
    got = prefixes(spark, rows)
    assert want and want <= set(got) and len(got) == len(set(got))


def test_one_shingle_of_all_sets_pairs_nobody(spark, monkeypatch):
    """Sets that share one shingle, and have another that a few share: pairs don't grow with the square of the rows."""
    monkeypatch.setattr(near_dups, "COMMON", 10)
    found = []
    for n in (200, 400):
        rows = [(k, f"one shingle of all sets mine{k // 2} and {'x' if k % 2 else 'y'}", None) for k in range(n)]
        found.append(len(prefixes(spark, rows)))
    assert found[1] <= 2.5 * max(found[0], 1) and found[1] < 400 * 2


def test_recall_at_the_threshold(spark):
    """Pairs at exactly 85 per cent agree in enough coordinates."""
    rng = random.Random(23)
    rows = []
    for k in range(2000):
        words = [f"{rng.randrange(10**9):x}" for _ in range(189 + 15)]
        rows += [(2 * k, " ".join(words[:189])), (2 * k + 1, " ".join(words[15:]))]
    assert 100 * len(shingles(rows[0][1]) & shingles(rows[1][1])) == 85 * len(shingles(rows[0][1]) | shingles(rows[1][1]))
    tokens = {r["key"]: np.array(r["tokens"]) for r in near_dups.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    agree = np.array([(tokens[2 * k] == tokens[2 * k + 1]).sum() for k in range(2000)])
    assert agree.min() >= near_dups.least_matches(85) and abs(agree.mean() - 0.85 * near_dups.COORDINATES) < 0.3
