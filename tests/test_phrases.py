"""Automaton passes and exact rounding against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions.rounding import half_even
from folioflow.functions.text import corpus_tokens, salvage_tokens
from folioflow.operators import lexical, phrases, profiles
from folioflow.plans import documents

SF = "/root/testdata/sf0.001"


def plain_spans(text, lexicon):
    """Longest first; each phrase looks on after every occurrence, claimed or not."""
    low, taken, out = (text or "").lower(), set(), []
    for p in sorted({x.lower(): x for x in reversed(lexicon)}.values(), key=lambda x: (-len(x), x)):
        at = low.find(p.lower())
        while p.strip() and at >= 0:
            span = set(range(at, at + len(p)))
            if not span & taken:
                taken |= span
                out.append((p, at, at + len(p)))
            at = low.find(p.lower(), at + len(p))
    return sorted(out, key=lambda x: x[1])


def listed(spark, words):
    return spark.createDataFrame([(w,) for w in words], "phrase string")


def test_spans_equal_plain_version(spark):
    rnd = random.Random(1)
    lexicon = ["aba", "ab", "BA", "aabb", "b a", "é", "éa", "bbbb", "aa", " "]
    texts = [None, "", "ababab", "aaa", "Aabb éa"] + ["".join(rnd.choices("ab éA", k=rnd.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {}
    for r in phrases.phrase_spans(df, listed(spark, lexicon)).orderBy("id", "start").collect():
        got.setdefault(r["id"], []).append((r["phrase"], r["start"], r["end"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_spans(t, lexicon), t


def test_greedy_query_equals_plain_version(spark):
    lexicon = ["the and", "and", "idiot", "ing", "thing", "license"]
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for p, _, _ in plain_spans(r["text"], lexicon):
            n, sources = want.setdefault((r["lang"], p), [0, set()])
            want[r["lang"], p][0] = n + 1
            sources.add(r["source"])
    got = {(r["lang"], r["phrase"]): (r["n_hits"], r["n_channels"]) for r in documents.phrase_greedy(spark, SF).collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_document_counts(spark, block):
    docs = spark.createDataFrame([("One two",), ("TWO two three",), (None,), ("",), ("Österreich",)], "text string")
    got = phrases.document_counts(docs, listed(spark, ["two", "Two", "one t", "öst", "none", "", " ", None]), block_chars=block)
    assert {r["phrase"]: r["df"] for r in got.collect()} == {"two": 2, "Two": 2, "one t": 1, "öst": 1, "none": 0, "": 0, " ": 0}
    assert phrases.document_counts(docs.limit(0), listed(spark, ["a"])).collect() == [("a", 0)]
    assert phrases.document_counts(docs, listed(spark, [])).count() == 0


def test_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEXICON_CHARS", 5)
    with pytest.raises(ValueError):
        phrases.lexicon_list(listed(spark, ["abc", "def"]))


def plain_tags(text, taxonomy, least=0.15, top=3):
    out = []
    for dim in sorted({x[0] for x in taxonomy}):
        scored = []
        for code in sorted({x[1] for x in taxonomy if x[0] == dim}):
            terms = [t for d, c, t in taxonomy if (d, c) == (dim, code)]
            hits = []
            for t in terms:
                word = " " not in t and t.isascii() and (len(t) <= 5 or t == t.upper())
                if re.search(rf"\b{re.escape(t)}\b", text) if word else t.lower() in text.lower():
                    hits.append(t)
            strength = min(1.0, len(hits) / math.sqrt(len(terms)))
            if strength >= least:
                scored.append((-strength, code, len(hits), hits[:6]))
        out += [(dim, code, n, -s, i + 1, e) for i, (s, code, n, e) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [20, 1 << 20])
def test_tags_equal_plain_version(spark, block):
    rnd = random.Random(2)
    taxonomy = [("f", "A", "EEG"), ("f", "A", "brain wave"), ("f", "B", "rat"), ("f", "B", "memory"), ("f", "C", "한국"), ("f", "D", "c+"), ("f", "E", "wave"), ("m", "F", "LONGACRONYM"), ("m", "F", "rat_")]
    taxonomy += [("m", "G", f"term number {i}") for i in range(9)]
    pieces = ["EEG", "eeg", "brain", "wave", "rat", "strategy", "Memory", "한국어", "c+", "c+d", "LONGACRONYM", "longacronym", "rat_", *[f"term number {i}" for i in range(9)]]
    texts = ["".join(w + rnd.choice([" ", "", "-", "_", ". "]) for w in rnd.choices(pieces, k=rnd.randint(0, 14))) for _ in range(150)]
    texts += ["가EEG나", "éEEG EEGé", "EEG²", "(EEG)"]
    df = spark.createDataFrame([*enumerate(texts), (None, "EEG"), (999, None)], "doc_id int, text string")
    tax = spark.createDataFrame([(*x, i) for i, x in enumerate(taxonomy)] + [("m", "G", " ", 99)], "dim string, code string, term string, place int")
    got = {}
    for r in lexical.dim_tags(df, tax, place="place", block_chars=block).collect():
        got.setdefault(r["doc_id"], []).append((r["dim"], r["code"], r["hits"], r["strength"], r["rank"], r["evidence"]))
    assert 999 not in got and [x[1] for x in got[None]] == ["A"]
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_tags(t, taxonomy), t


def test_tokens(spark):
    row = spark.createDataFrame([("fMRI_2 12345 v1 visual-cortex a-b état 신경망 기억 x² the",)], "x string")
    assert row.select(corpus_tokens("x")).first()[0] == ["fmri_2", "visual", "cortex", "état", "신경망", "the"]
    assert row.select(salvage_tokens("x", ["the"])).first()[0] == ["fmri", "visual-cortex"]


def test_text_fingerprint(spark):
    texts = spark.createDataFrame([("u", "anchor", "Working memory and memory"), ("u", "context", "memory"), ("v", "paradigm", "rarely rarely common"), ("u", "other", "memory"), (None, "anchor", "memory"), ("w", "anchor", None)], "user string, channel string, text string")
    idf = spark.createDataFrame([("MEMORY", 2.0)], "phrase string, idf double")
    tokens = spark.createDataFrame([("rarely", 4.5), ("common", 1.0), ("memory", 9.0), ("working", 4.0)], "token string, idf double")
    got = {(r["user"], r["phrase"]): (r["score"], r["channels"], r["n_hits"], r["rank"]) for r in profiles.text_fingerprint(texts, listed(spark, ["memory", "working memory"]), idf, tokens).collect()}
    assert got == {
        ("u", "working memory"): (5.0, ["anchor"], 1, 1), ("u", "memory"): (2.8, ["anchor", "context"], 2, 2), ("u", "working"): (4.0, ["passB.tfidf"], 1, 3),
        ("v", "rarely"): (7.2, ["passB.tfidf"], 2, 1),
    }


def test_rounding_equals_python(spark):
    rnd = np.random.default_rng(7)
    n = 60_000
    values = [rnd.normal(size=n) * 10.0 ** rnd.integers(-8, 17, size=n), rnd.integers(-(10**7), 10**7, size=n) / 1000, (rnd.integers(-(10**6), 10**6, size=n) * 2 + 1) / 2.0 ** rnd.integers(1, 12, size=n)]
    values.append(rnd.integers(-(2**53), 2**53, size=n) / 2.0 ** rnd.integers(0, 5, size=n))
    values.append(np.nextafter((rnd.integers(0, 10**6, size=n) + 0.5) / 1000, rnd.choice([-np.inf, np.inf], size=n)))
    x = np.concatenate([*values, [2.675, 0.125, 0.375, -0.125, 1e300, -1e300, 5e-324, 0.0, -0.0, 2.0**52 + 0.5, 4503599627370497.5, 0.5, 1.5, 2.5]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    got = df.select("x", *[half_even("x", k).alias(f"r{k}") for k in (0, 2, 3, 6)]).collect()
    assert len(got) == len(x)
    for r in got:
        for k in (0, 2, 3, 6):
            want = round(r["x"], k) if k else float(round(r["x"]))
            assert r[f"r{k}"] == want, (r["x"], k)
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "x double").select(half_even("x", 3)).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0]) and odd[2][0] == math.inf
    with pytest.raises(ValueError):
        half_even(F.lit(1.0), 16)


def test_phrase_counts_equal_plain_version(spark):
    rnd = random.Random(12)
    listed_ = ["aa", "aba", "", "b a", "é", "aa", "zz"]
    texts = [None, "", "aaaa AAA", "ababa"] + ["".join(rnd.choices("ab éA", k=rnd.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r["id"]: r["tf"] for r in phrases.phrase_counts(df, listed_).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(t or "").lower().count(p) if p else 0 for p in listed_], t
    assert [r["tf"] for r in phrases.phrase_counts(df.limit(2), []).collect()] == [[], []]
