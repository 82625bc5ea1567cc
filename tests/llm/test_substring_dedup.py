"""Repeated windows against all windows; the pipeline's stages."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from folioflow.llm import substring_dedup

SCHEMA = "doc_id long, text string, kept string"


def brute(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order(i):
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(500)] + ["é😀", "a.b"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, line = make(70), make(50)
    rows = []
    for k in range(60):
        w = make(rng.randrange(0, 160))
        if k % 2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.choice([49, 50, 51, 70])]
        if k % 5 == 0:
            w += line * 3
        rows.append((1000 - k, rng.choice([" ", "\n", "  \t"]).join(w), "x"))
    long = make(3000)
    rows += [(5, " ".join(long), None), (4, " ".join(long[500:900] + make(30)), None)]
    rows += [(2000 + k, rows[1][1], None) for k in range(10)] + [(7, None, None), (8, "", None), (9, "a b " * 80, None), (10, "b a " * 80, None)]
    return rows + [(None, rows[1][1], None), (2000, rows[1][1], None)]


@pytest.mark.parametrize("hot, group", [(2000, 20_000), (20, 40), (5, 40), (1, 1)])
def test_all_windows(spark, hot, group):
    rows = planted()
    got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA), hot=hot, group=group).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)


def test_prefixes_are_lengthened_until_they_fit(spark):
    rng = random.Random(7)
    make = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    common, ways = make(40), [make(60) for _ in range(10)]
    rows = planted() + [(3000 + k, " ".join(make(5) + common + ways[k % 10]), None) for k in range(40)]  # one start, ten ways to go on
    got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA), hot=6, group=40).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)
    named = substring_dedup._named(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    lengths = {}
    for hot in (6, 2000):
        trees, nodes = substring_dedup.partitioned(named, hot)
        sizes = trees.groupBy("n_prefix", "gram").agg({"spans": "count"}).collect()
        assert all(r["cnt"] <= hot for r in trees.select("cnt").collect())
        lengths[hot] = {r["n_prefix"] for r in sizes} | {r["n_prefix"] for r in nodes.select("n_prefix").distinct().collect()}
    assert lengths[6] == {20, 35, 50} and lengths[2000] == {20}


def test_tree_is_the_sorted_suffixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 3, size=(60, 8)).astype(np.int32)
    size = rng.integers(0, 9, size=60)
    rows[np.arange(8) >= size[:, None]] = 0
    tree = substring_dedup.Tree(rows, size)
    for depth in range(9):
        nodes = tree.nodes(depth)
        for i in range(60):
            for j in range(60):
                if size[i] >= depth and size[j] >= depth:
                    assert (nodes[i] == nodes[j]) == (rows[i, :depth] == rows[j, :depth]).all()


@pytest.mark.parametrize("hot, group", [(2000, 20_000), (5, 40)])
def test_maximal_repeats(spark, hot, group):
    rows = [r for r in planted() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = substring_dedup.maximal_repeats(spark.createDataFrame(rows, SCHEMA), hot=hot, group=group).collect()
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    first = {}
    for i, w in sorted(words.items()):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = []
    for i, w in words.items():
        hit = [first[tuple(w[k : k + 50])] < i for k in range(len(w) - 49)]
        starts = [k for k, h in enumerate(hit) if h and not (k and hit[k - 1])]
        want += [(i, k, next((j for j in range(k, len(hit)) if not hit[j]), len(hit)) - k + 49) for k in starts]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pipeline(spark, tmp_path):
    import sentencepiece

    from folioflow.llm.sentencepiece_codec import piece_model_path

    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice(["the", "and", "thing", "erth", "oning"]) + str(rng.randrange(999)) for _ in range(n))
    item = make(20)
    base = make(100)
    texts = {1: make(50), 2: base, 3: base, 4: base.upper(), 5: make(40) + " " + item + " " + make(9), 6: "123 456", 7: None, 8: make(30) + " token=abcdefghijklmnop12", 9: make(12), 10: ""}
    docs = [(i, t, "en", f"s{i}", len(t or "")) for i, t in texts.items()] + [(9, texts[9], "en", "s9", 1), (None, make(15), None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(["1", "2", "8", "9", "None"])
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    for r in got:
        want = texts.get(r.doc_id, r.text).replace("abcdefghijklmnop12", "[SECRET]")
        assert r.text == want and r.ids == sp.encode(want) and r.n_tokens == len(r.ids) and r.round_trip
        assert r.lang == "en"


def test_pipeline_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []


def test_stages_keep_columns(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "some text the and")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    df = spark.createDataFrame([(1, "the and of it is here now", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns and out.count() == 1


def test_digest_of_kept(spark, tmp_path):
    spark.createDataFrame([(1, "a  b\nc")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = substring_dedup.op8(spark, str(tmp_path)).first()
    assert (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) == (1, 3, 0, hashlib.sha256(b"a b c").hexdigest())
