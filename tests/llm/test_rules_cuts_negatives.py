"""Quality rules, fill-in-the-middle and hard negatives against plain versions, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import fill_middle, hard_negatives, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# Quality rules


def plain_counts(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_bangs": (text or "").count("!"), "n_capitals": len(re.findall("[A-Z]", text or "")), "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words),
    }


def plain_fails(rules, c):
    out = []
    for r in rules:
        of = c[r.of] if r.of else 1
        if (r.low is not None and 100 * c[r.count] < r.low * of) or (r.high is not None and 100 * c[r.count] > r.high * of):
            out.append(r.name)
    return out


def test_rules_equal_plain_version(spark):
    rnd = random.Random(3)
    pieces = ["the", "of", "A", "b!", "é", "漢字", "😀", "#*", "<x>", "|", "the of A b the", " ", "\n", "\t", "\x0b", "\r\n", "\x85", "\xa0", "\0", "x y z u v w\n"]
    texts = [None, "", " \n\t ", "x", "a\n\na\n \na", "w " * 4000, "long" * 50_000, " lead", "trail \n"]
    texts += [" ".join(rnd.choices(pieces, k=rnd.randint(0, 80))) for _ in range(150)] + ["".join(rnd.choices(pieces, k=rnd.randint(0, 80))) for _ in range(100)]
    texts += texts[-3:]  # repeated rows
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["v"] for r in quality_rules.judge(rows, out="v").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = plain_counts(text)
        assert {c: got[i][c] for c in want} == want, text
        base, more = plain_fails(quality_rules.BASE, want), plain_fails(quality_rules.TABLE, want)
        assert got[i]["failed"] == base + more
        assert got[i]["base_failed"] == bool(base) and got[i]["kept"] == (not base + more)


def test_rules_other_table_columns_and_empty_input(spark):
    rows = spark.createDataFrame([(None, "a b", 1, "x")], "doc_id long, text string, n_words int, quality_verdict string")
    one = quality_rules.judge(rows, base=[], rules=[quality_rules.Rule("short", "n_words", "", low=300), quality_rules.Rule("chars", "word_chars", "n_words", high=100)]).first()
    assert one["n_words"] == 1 and one["quality_verdict"] == "x" and one["quality_verdict_"]["failed"] == ["short"]
    assert quality_rules.judge(rows, base=[], rules=[]).first()["quality_verdict_"]["kept"]
    assert quality_rules.judge(rows.limit(0)).count() == 0


def test_rules_run_in_the_jvm(spark):
    plan = quality_rules.op11(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_rules_tell_labelled_quality(spark):
    d = "/root/testdata/sf0.01"
    seen = quality_rules.op11(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in seen.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.03


# Fill in the middle


def plain_cut(text, h, rate, spm):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def numbers(key, seed=42):
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1024])
def test_cuts_equal_plain_version(block):
    rnd = random.Random(block)
    pieces = [" ", "\n", "a", "é", "漢", "😀", "<", "P", "M", ">", "<P", "<S>", "\x0b", "\x85", "\xa0", "\0", "word "]
    for _ in range(60):
        texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 60))) for _ in range(20)]
        h = [[rnd.randrange(2**32) for _ in range(4)] for _ in texts]
        got = [(*r[:4], r[4].decode()) for r in fill_middle.arranged([t.encode() for t in texts], np.array(h), 80, 50, block)]
        assert got == [plain_cut(t, x, 80, 50) for t, x in zip(texts, h, strict=True)]


def test_blocks_of_broken_bytes_agree_with_one_scan():
    rnd = np.random.default_rng(5)
    texts = [rnd.integers(0, 256, size=n, dtype=np.uint8).tobytes() for n in (1, 50, 400, 999)]
    whole, parts = fill_middle.Scan(texts, 4096), fill_middle.Scan(texts, 3)
    assert (whole.units == parts.units).all() and (whole.chars == parts.chars).all()


def test_transform_rows(spark):
    long_text = "wörd " * 60_000
    texts = {0: None, 1: "", 2: " \n ", 3: "a <P> b", 4: long_text, 5: "x" * 300_000, 6: "a < b <P c>", None: "no key at all"}
    rows = spark.createDataFrame([(k, t, "kept", 7) for k, t in texts.items()] + [(6, texts[6], "kept", 7)], "doc_id long, text string, n string, OUTPUT int")
    done, c = fill_middle.transform(rows, rate=100)
    assert c["n"] == "n_" and c["output"] == "output_"
    got = done.withColumn("back", fill_middle.restored(F.col(c["output"]), F.col(c["form"]))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc_id"]]
        assert (r["n_"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_"]) == plain_cut(text, numbers(r["doc_id"]), 100, 80)
        assert r["back"] == (text or "") and r["n"] == "kept" and r["OUTPUT"] == 7
    assert fill_middle.transform(rows.limit(0))[0].count() == 0
    assert fill_middle.transform(rows.repartition(5), rate=100)[0].orderBy("doc_id").collect() == done.orderBy("doc_id").collect()


# Hard negatives


def plain_mine(rows, positives=5, negatives=3, low=50, high=95):
    """rows: (id, vector, label, is anchor)."""
    sound = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max((len(r[1]) for r in sound), default=0)
    sound = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), y, a) for i, v, y, a in sound]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, v, y, a in sound:
        if not a:
            continue
        scores = [(sum(p * q for p, q in zip(v, w, strict=True)), j, z) for j, w, z, _ in sound]
        for p, j, _ in sorted([s for s in scores if s[2] == y and s[1] != i], key=order)[:positives]:
            found = sorted([s for s in scores if s[2] != y and low * p <= 100 * s[0] <= high * p], key=order)[:negatives]
            out += [(i, j, rank + 1, s[1], p, s[0]) for rank, s in enumerate(found)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "x", 1.0) for i, v, y, _ in rows], "vec_id long, embedding array<float>, label int, score string, row double").repartition(3)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 5 == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(kind, n, rnd):
    spread = {"spread": 1.0, "tight": 0.05, "large": 3e4}[kind]
    base = rnd.normal(size=(4, 6))
    out = [(i, (base[i % 4] * (1 if kind == "tight" else 0.3) + rnd.normal(size=6) * spread).astype(np.float32).tolist(), int(rnd.integers(0, 3)), i % 5 == 0) for i in range(n)]
    return out


@pytest.mark.parametrize("kind", ["spread", "tight", "large"])
def test_negatives_equal_plain_version(spark, monkeypatch, kind):
    for name, value in (("SAMPLE", 60), ("CELLS", 4), ("BLOCK", 40), ("SLICE", 20), ("LEAF", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(kind, 240, np.random.default_rng(1))
    want = plain_mine(rows)
    assert want and mined(spark, rows) == want


def test_negatives_with_nulls_ties_and_copies(spark):
    rnd = np.random.default_rng(2)
    rows = vectors("spread", 60, rnd)
    same = [0.5, 0.25, 0.0, 0.1, 0.2, 0.3]
    rows += [(100 + i, same, i % 2, i % 5 == 0) for i in range(40)]  # ties
    rows += [rows[7], rows[10], rows[10]]  # repeated rows, an anchor too
    rows += [(None, same, 1, False), (200, None, 1, True), (205, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, True), (210, same, None, True), (215, [float("nan")] * 6, 0, True), (220, [float("inf")] * 6, 0, True), (225, [], 0, True), (230, [2.0], 1, True), (235, [0.0] * 6, 2, True)]
    assert mined(spark, rows) == plain_mine(rows)
    assert mined(spark, rows, positives=2, negatives=4, low=10, high=100) == plain_mine(rows, 2, 4, 10, 100)


def test_negatives_of_one_vector_only_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rows = [(i, [0.5, 0.5], i % 2, i % 5 == 0) for i in range(80)]  # all scores are equal, above every window
    assert mined(spark, rows) == plain_mine(rows) == []
    assert mined(spark, rows, high=100) == plain_mine(rows, high=100) != []
    assert mined(spark, []) == [] and mined(spark, [(3, [1.0], 1, False)]) == [] and mined(spark, [(5, [1.0], 1, True)]) == []


def test_products_beyond_doubles_are_exact():
    a = np.array([[2**28 + 1, 3], [-(2**28) - 5, 7]], dtype=np.int64)
    assert hard_negatives.products(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in a] for x in a]


def test_ids_and_labels_of_any_type(spark):
    rows = vectors("spread", 80, np.random.default_rng(6))
    want = [(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", f"2024-01-01 00:{j // 60:02d}:{j % 60:02d}", *rest) for i, j, *rest in plain_mine(rows)]
    df = spark.createDataFrame([(i, v, f"l{y}") for i, v, y, _ in rows], "i int, embedding array<float>, label string").withColumn("vec_id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i")))
    got = hard_negatives.mine(df, F.col("i") % 5 == 0).select(F.col("anchor_id").cast("string"), F.col("positive_id").cast("string"), "rank", F.col("negative_id").cast("string"), "positive_score", "negative_score").collect()
    assert sorted(map(str, ((a, p, k, s, t) for a, p, k, _, s, t in got))) == sorted(map(str, ((a, p, k, s, t) for a, p, k, _, s, t in want)))
