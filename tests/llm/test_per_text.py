"""Operators that judge each text alone: sharding, language, SentencePiece, media, toxicity, decontamination."""

import gzip
import io
import random
import struct
import time
import zipfile
import zlib
from decimal import Decimal

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, language_id, media, sentencepiece_codec, sharding, toxicity, wordhash
from folioflow.llm.common import table

SF = "/root/testdata/sf0.01"
MODEL = sentencepiece_codec.piece_model_path()


# --- sharding ---------------------------------------------------------------------------------------


def test_table_is_even_and_stable():
    names = sharding.shard_names(16)
    owner = sharding.lookup_table(names)
    share = np.bincount(owner, minlength=16)
    assert share.max() - share.min() <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 15)
    assert moved < 0.25 * len(owner)


def test_place(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "doc_id long, slot string")
    got = sharding.place(df, "doc_id", ["x", "y", "z"], 101).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id == 1}) == 1
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


# --- SentencePiece ----------------------------------------------------------------------------------


def texts():
    rng = random.Random(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [sp.id_to_piece(i) for i in range(300, 32000)]
    odd = ["", None, " ", "   ", "a" * 3000, "=" * 2000, "-_" * 900, " " * 1500, "ab" * 900 + " " * 50 + "\n" * 100, "<s></s><unk>", "▁▁ a▁b", "日本語😀\0\u200b", "The cat\tsat"]
    odd += ["".join(rng.choice("  ▁\n\tabcthe éñ<s>0日😀.,-\u3000") for _ in range(rng.randrange(40))) for _ in range(300)]
    odd += ["".join(rng.choice(" ab the in") for _ in range(rng.randrange(60))) for _ in range(300)]
    return odd + ["".join(rng.choice(pieces) for _ in range(rng.randrange(10))).replace("▁", " ") for _ in range(600)]


def test_codec_equals_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = sentencepiece_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(r.text or "")
        assert r.ids == "x" and r.ids_ == ids and r.decoded == sp.decode(ids)


def test_codec_leaves_columns_alone(spark):
    df = spark.createDataFrame([("a text", "kept", 7)], "text string, Decoded string, IDS int")
    out = sentencepiece_codec.encode_decode(df, MODEL)
    assert out.columns == ["text", "Decoded", "IDS", "ids_", "decoded_"] == [*df.columns, *sentencepiece_codec.result_names(df)]
    assert out.first()[1:3] == ("kept", 7) and out.first()[4] == "a text"
    assert sentencepiece_codec.decode(out, MODEL, "ids_", "decoded").first()["decoded__"] == "a text"


def test_worker_keeps_one_codec(monkeypatch):
    from types import SimpleNamespace

    monkeypatch.setattr(sentencepiece_codec, "_CODECS", {})
    a, b = (SimpleNamespace(value=sentencepiece_codec.load_model(MODEL)) for _ in range(2))
    first = sentencepiece_codec._codec(a)
    assert sentencepiece_codec._codec(a) is first and sentencepiece_codec._codec(b) is not first and len(sentencepiece_codec._CODECS) == 1


def test_decode_any_ids(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    lists = [[rng.randrange(32000) for _ in range(rng.randrange(12))] for _ in range(200)] + [[rng.randrange(3, 259) for _ in range(6)] for _ in range(100)] + [[], [0], [1, 0, 300], [2, 259]]
    got = sentencepiece_codec.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "k int, ids array<int>"), MODEL).collect()
    assert {r.k: r.decoded for r in got} == {i: sp.decode(x) for i, x in enumerate(lists)} | {-1: ""}


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_WORDS", 5)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_model(MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in (["one two three", "four five six seven eight"], ["one nine ten", "two four"]):
        ids, ends = codec.encode(t)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == sp.encode(t)


# --- language ---------------------------------------------------------------------------------------


def test_automaton_accepts_substrings():
    rng = random.Random(4)
    seq = [rng.randrange(3) for _ in range(60)]
    step = language_id.suffix_automaton(seq, 3)

    def accepts(x):
        s = 0
        for c in x:
            s = step[s, c]
            if s < 0:
                return False
        return True

    subs = {tuple(seq[i:j]) for i in range(60) for j in range(i, min(60, i + 7) + 1)}
    from itertools import product

    for n in range(1, 7):
        for x in product(range(3), repeat=n):
            assert accepts(x) == (x in subs)


def test_phrases_equal_plain_parsing(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs)
    got_texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["", "1 2 3", "É"]
    got, size = language_id.phrases(model, got_texts)
    for i, t in enumerate(got_texts):
        sym = [s for s in model.symbol_of[[min(ord(c), 0xFFFF) for c in t]].tolist() if s] if t else []
        assert len(sym) == size[i]
        for k, root in enumerate(model.root.tolist()):
            n = 0
            for a in range(0, len(sym), language_id.BLOCK):
                state, n = root, n + 1
                for c in sym[a : a + language_id.BLOCK]:
                    nxt = model.step[state * model.columns + c]
                    if nxt < 0:
                        n += 1
                        nxt = model.step[root * model.columns + c]
                        nxt = root if nxt < 0 else nxt
                    state = nxt
            assert got[i, k] == n


def test_language_held_out(spark):
    got = {r.doc_id: r for r in language_id.op3(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "lang", "n_chars").collect()
    held = [d for d in docs if got[d.doc_id].held_out and d.n_chars > 60]
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, g in got.items())
    assert len(got) == len(docs) and sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97


def test_language_odd_rows(spark):
    model = language_id.fit(table(spark, SF, "documents"))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "日本"), (None, "the and the"), (4, "日本")], "doc_id long, text string")
    got = language_id.identify(df, model).collect()
    assert [r.lang_pred == "und" for r in sorted(got, key=lambda r: str(r.doc_id))] == [True, True, True, False, False, False]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.fit(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")) is None


def test_languages_of_many_letters(spark, monkeypatch):
    rng = random.Random(9)
    scripts = {"aa": range(0x61, 0x7B), "el": range(0x3B1, 0x3C9), "ko": range(0xAC00, 0xAE00), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x5000), "zz": range(0x20000, 0x20040)}
    words = {n: ["".join(rng.choices([chr(c) for c in points], k=4)) for _ in range(60)] for n, points in scripts.items()}
    make = lambda n: " ".join(rng.choices(words[n], k=20))
    rows = [(k, make(n), n) for k, n in enumerate([*scripts] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts_ = {n: [make(n) for _ in range(5)] for n in scripts}
    for k, n in enumerate(model.names):
        total, size = language_id.phrases(model, texts_[n])
        assert (size == [len(t) for t in texts_[n]]).all() and (np.delete(total, k, axis=1) > 2 * total[:, [k]]).all()
    assert language_id.phrases(model, ["\u0e01\u0e02 \U00030000"])[1].tolist() == [4]  # letters of no sample count


@pytest.mark.parametrize("size", [1, 3, 69])
def test_blocks_of_languages_equal_one_block(spark, monkeypatch, size):
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{n:02d}": ["".join(rng.choices(letters[n % 13 : n % 13 + 12], k=5)) for _ in range(8)] for n in range(70 if size == 69 else 7)}
    make = lambda n: " ".join(rng.choices(words[n], k=12))
    rows = [(k, make(n), n) for k, n in enumerate([*words] * 6)] + [(999, "1 2 3", "l03a"), (998, "4", "zz")]  # a block may have nothing to learn from
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fresh = spark.createDataFrame([(k, make(n), "x") for k, n in enumerate(words)] + [(-1, None, "x"), (-2, "", "x"), (-3, "12", "x"), (-4, "日本", "x"), (-5, "a", None)], "doc_id long, text string, _least string")
    go = lambda: sorted(map(tuple, language_id.identify(fresh, language_id.fit(df)).collect()))
    want = go()
    monkeypatch.setattr(language_id, "LANGUAGES", size)
    assert go() == want


def test_any_number_of_languages_and_letters(spark, monkeypatch):
    """70 languages with letters of their own, more than 6,000 in all; the dense table has room for the least alphabet only."""
    rng = random.Random(12)
    monkeypatch.setattr(language_id, "TABLE_BYTES", 1 << 20)
    words = {f"l{n:02d}": ["".join(chr(0x4E00 + 90 * n + rng.randrange(90)) for _ in range(4)) for _ in range(80)] for n in range(70)}
    make = lambda n: " ".join(rng.choices(words[n], k=40))
    rows = [(k, make(n), n) for k, n in enumerate([*words] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert len(model.names) == 70 and model.width > 6_000 and model.columns < language_id.ALPHABET
    fresh = spark.createDataFrame([(k, make(n), n) for k, n in enumerate([*words] * 2)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang and r.score > 0.5 for r in language_id.identify(fresh, model).collect())


def test_sample_is_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "RANKED", 2)
    rng = random.Random(13)
    rows = [(k, f"row{k} " + "word " * rng.randrange(12, 300), "aa") for k in range(3000)] + [(k, "x" * 30_000 + f"y{k}", "bb") for k in range(5)] + [(9, "short", "cc"), (None, None, "cc"), (8, "12", "dd"), (7, "text", None)]
    got, _ = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"aa", "bb", "cc"} and got["cc"] == "short" and set(got["bb"]) == {"x"} and len(got["bb"]) == language_id.SAMPLE_CHARS
    assert 0.8 * language_id.SAMPLE_CHARS < len(got["aa"]) <= language_id.SAMPLE_CHARS
    whole = {t.strip() for _, t, n in rows if n == "aa"}
    assert all("row" + x.strip() in whole for x in got["aa"].split("row")[1:])


EMPTY = "doc_id long, text string, lang string, score string, Lang_Pred int, slot int, ids string, offending int"


@pytest.mark.parametrize("go", [
    lambda df: language_id.identify(df, language_id.fit(df)), lambda df: language_id.identify(df, None), lambda df: sharding.place(df, "doc_id", ["a", "b"], 101),
    lambda df: sentencepiece_codec.encode_decode(df, MODEL), lambda df: toxicity.score(df, None), lambda df: toxicity.score(df, toxicity.fit(df, df.selectExpr("doc_id", "slot AS toxic"))),
    lambda df: df.withColumn("blob", F.col("text").cast("binary")).withColumn("media", media.sniff("blob", "text")),
])
def test_empty_tables_and_clashing_names(spark, go):
    df = spark.createDataFrame([], EMPTY)
    assert go(df).collect() == []
    some = spark.createDataFrame([(1, "some text here", "en", "99", 7, 3, "i", 4), (None, None, None, None, None, None, None, None)], EMPTY)
    out = go(some)
    assert out.count() == 2 and len({c.lower() for c in out.columns}) == len(out.columns) and {"doc_id", "text", "lang"} <= set(out.columns)


def test_media_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert media.op7(spark, str(tmp_path)).collect() == []


def test_language_names_can_be_chosen(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "the and of", None, 99.0, "x")], "doc_id long, text string, lang string, score double, _lang string")
    labelled = df.unionByName(spark.createDataFrame([(k, f"the and of thing{k} here " * 4, "en", 1.0, "y") for k in range(20)], df.schema))
    got = {r.doc_id: r for r in corpus_pipeline.identify_language(spark, labelled, "").collect()}
    assert len(got) == 20 and got[0].score == 1.0 and got[0]._lang == "y"


# --- media ------------------------------------------------------------------------------------------


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a.txt", "hello")
    return f.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cdxx\xff\0yy\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


@pytest.mark.parametrize("kind, data", [("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/zip", zipped()), ("application/gzip", gzip.compress(b"x" * 500)), ("application/pdf", PDF)])
def test_formats(kind, data):
    assert (0, len(data), kind) in media.files_in(data)
    assert (7, len(data), kind) in media.files_in(b"padding" + data)
    assert not [x for x in media.files_in(data[:-3]) if x[0] == 0]


def test_sniff(spark):
    both = png() + b"tail" + GIF
    df = spark.createDataFrame([(1, bytearray(both), "image/gif"), (2, None, "audio/wav"), (3, bytearray(b""), None), (4, bytearray(b"RIFFxxxxWAVE"), "text/plain")], "k int, b binary, d string")
    got = {r.k: r.s for r in df.withColumn("s", media.sniff("b", "d")).collect()}
    assert (got[1].type, got[1].corrected, got[1].length) == ("image/png", True, len(png()))
    assert [(c.offset, c.type) for c in got[1].carved] == [(len(png()) + 4, "image/gif")]
    assert got[2].type == "audio/wav" and got[3].type is None and got[4].type == "text/plain" and got[4].length is None


def test_media_round_trip(spark, tmp_path):
    import hashlib

    rows = [(1, "aé😀"), (2, None), (3, ""), (4, "x" * 576), (5, "x" * 577), (6, "GIF89a RIFF PK\x03\x04 BM" * 40), (1, "aé😀")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op7(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        stored = b"RIFF" + struct.pack("<I", len(pay) + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(pay)) + pay
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature.startswith("audio/wav;")


# --- toxicity ---------------------------------------------------------------------------------------


def test_noisy_or_is_exact():
    weights = np.zeros(1 << toxicity.DIM_BITS, dtype=np.float32)
    text = [b"Bad words here. Fine now!\nBad again", b"", b"..."]
    bags = toxicity.bags_of(text)
    weights[bags.feature[0]] = 3.0
    p = 1 / (1 + np.exp(-(toxicity.sentence_logits(bags, weights, -2.0))))
    assert np.allclose(p, [1 / (1 + np.exp(-1)), 1 / (1 + np.exp(2)), 1 / (1 + np.exp(-1))])
    assert np.allclose(toxicity.document_scores(bags, np.log(p / (1 - p))), [1 - np.prod(1 - p), 0, 0])


def plain_left(text, weight, bias):
    """The chance that no sentence is toxic, by the definition, word by word."""
    import re

    left = 1.0
    for sentence in re.split(rb"[.!?\n]", text):
        words = re.findall(rb"[a-z\x80-\xff]+", sentence.lower())
        if words:
            left *= 1 - 1 / (1 + np.exp(-bias - sum(weight(w) for w in words)))
    return left


def test_scores_and_gradient_against_brute_force():
    rng = random.Random(14)
    vocab = [b"bad", b"worse", b"fine", b"the", "é😀".encode(), b"Thing"]
    texts_ = [b" ".join(rng.choice([*vocab, b".", b"!", b"\n", b"12"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [b"", b"..."]
    place = {w: int(toxicity.bags_of([w]).feature[0]) for w in vocab}
    assert len(set(place.values())) == len(vocab)
    weights = np.zeros(1 << toxicity.DIM_BITS)
    for f in place.values():
        weights[f] = rng.uniform(-2, 2)
    bags = toxicity.bags_of(texts_)
    got = toxicity.document_scores(bags, toxicity.sentence_logits(bags, weights, -0.7))
    want = [1 - plain_left(t, lambda w: weights[{k.lower(): v for k, v in place.items()}[w]], -0.7) for t in texts_]
    assert np.allclose(got, want)

    labels = np.array([rng.randrange(2) for _ in texts_])
    labels[np.array(want) == 0] = 0  # without a sentence the likelihood of label 1 is 0 whatever the weights
    sentence = np.repeat(np.arange(len(bags.begin)), np.diff(np.append(bags.begin, len(bags.feature))))
    used = sorted(place.values())
    word = np.searchsorted(used, bags.feature)
    w = np.append(weights[used], -0.7)

    def loss(w):
        left = np.array([plain_left(t, lambda x: w[used.index({k.lower(): v for k, v in place.items()}[x])], w[-1]) for t in texts_])
        return -np.mean(np.log(np.where(labels > 0, 1 - left, left)))

    slope = [(loss(w + h) - loss(w - h)) / 2e-5 for h in np.eye(len(w)) * 1e-5]
    assert np.allclose(toxicity.gradient(w, word, sentence, bags.doc, labels), slope, atol=1e-6)


def test_sampling_of_labels_works_at_any_number(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: taken.append(len(texts)) or (np.zeros(1 << toxicity.DIM_BITS, dtype=np.float32), 0.0))
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert toxicity.fit(docs, labels, rows=500) and 350 < taken[0] < 650
    for n in (10**10, 10**14, 10**18):  # the share of the hash range stays above 0
        assert 0 < int(toxicity.LARGEST * toxicity.TRAIN_ROWS / n) <= toxicity.LARGEST * toxicity.TRAIN_ROWS // n + 2**20
    long = docs.where("doc_id < 4").selectExpr("doc_id", f"repeat('long text ', {toxicity.TRAIN_CHARS}) AS text")
    assert toxicity.fit(long, labels) is None  # rows that are too long are left out whole


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in toxicity.op10(spark, "/root/testdata/sf0.1").collect()}
    labels = table(spark, "/root/testdata/sf0.1", "labels").collect()
    held = [(got[r.doc_id].score, r.toxic) for r in labels if got[r.doc_id].held_out]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.85
    words = "idiot moron clown loser stupid pathetic worthless".split()
    texts_ = table(spark, "/root/testdata/sf0.1", "documents").collect()
    insulting = [got[r.doc_id].predicted for r in texts_ if any(w in r.text for w in words)]
    clean = [got[r.doc_id].predicted for r in texts_ if not any(w in r.text for w in words)]
    assert np.mean(insulting) > 0.95 and np.mean(clean) < 0.06


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"you {'zzbad' if i % 2 else 'fine'} thing. word{i} here", 5) for i in range(200)] + [(None, None, 1), (7, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 202 and all((r.score >= 0.3) == ("zzbad" in (r.text or "")) for r in got)
    assert all(bool(r.offending) == ("zzbad" in (r.text or "")) and all("zzbad" in s.sentence for s in r.offending) for r in got)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


# --- decontamination --------------------------------------------------------------------------------


def mutated(rng, words, n, vocab):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        match rng.choice("sid"):
            case "s":
                words[at] = rng.choice(vocab)
            case "i":
                words.insert(at, rng.choice(vocab))
            case _ if len(words) > 1:
                del words[at]
    return words


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2)]
        assert decontaminate.edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))[0] == distance(a, b)


def test_recall_at_the_limit(spark):
    rng = random.Random(3)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    vocab = [w for r in table(spark, SF, "documents").limit(100).collect() for w in r.text.split()]
    fill = lambda: rng.choices(vocab, k=rng.randrange(60))
    hits = [(i, " ".join(fill() + mutated(rng, t.split(), decontaminate.limit(len(t.split())), vocab) + fill())) for _ in range(8) for i, t in items]
    held = decontaminate.make_items(items)
    found = {(k, int(held.ids[m])) for k, m, *_ in decontaminate.matches(held, [t for _, t in hits])}
    assert sum((k, i) in found for k, (i, _) in enumerate(hits)) / len(hits) >= 0.98
    assert not decontaminate.matches(held, [" ".join(rng.choices(vocab, k=300)) for _ in range(50)])


def test_leaks_against_brute_force(spark):
    from folioflow.llm.wordhash import words_of

    docs, bench = table(spark, SF, "documents").limit(300), table(spark, SF, "benchmark")
    words = lambda t: words_of([t.encode()], fold=True, breaks=decontaminate.NO_WORD).hash.tolist()
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = set()
    for d in docs.collect():
        w = words(d.text)
        for i, x in items:
            if len(set(x) & set(w)) >= len(set(x)) - decontaminate.limit(len(x)) and distance(x, w) <= decontaminate.limit(len(x)):
                want.add((d.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want
    clean = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_leaks_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x one two three four y"), (1, "x one two three four y"), (2, None), (3, ""), (None, "ONE, two; three four"), (4, "one two x four")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "one two three four"), (8, None), (7, ""), (6, "!!")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [("1", 9), ("1", 9), ("None", 9)]
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == [] and decontaminate.leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == 6


def test_items_with_words_missing_stand_alone():
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(500)]
    texts_ = [rng.sample(vocab, n) for n in (5, 9, 10, 16, 30, 60) for _ in range(10)]
    held = decontaminate.make_items([(k, " ".join(t)) for k, t in enumerate(texts_)])
    missed = 0
    for k, t in enumerate(texts_):
        for n in range(1, decontaminate.limit(len(t)) + 1):
            gone = set(rng.sample(range(len(t)), n))
            short = " ".join(x for j, x in enumerate(t) if j not in gone)
            alone = [(i, *rest) for _, i, *rest in decontaminate.matches(held, [short])]
            missed += (k, n) not in [(int(held.ids[i]), edits) for i, edits, *_ in alone]
            # Neither place nor neighbours in the batch matter.
            for at, batch in ((0, [short, "more words " * 40]), (1, ["words before", short]), (1, ["", short, None, short])):
                assert [(i, *rest) for d, i, *rest in decontaminate.matches(held, batch) if d == at] == alone
    assert missed <= 0.02 * sum(decontaminate.limit(len(t)) for t in texts_)


@pytest.mark.parametrize("long", [10, 1 << 30])
def test_word_hashes_do_not_depend_on_the_way(monkeypatch, long):
    rng = random.Random(15)
    texts_ = [" ".join("".join(rng.choices("abcéZ", k=rng.randrange(1, 90))) for _ in range(rng.randrange(9))).encode() for _ in range(60)] + [b"x" * 200_000 + b" y"]
    monkeypatch.setattr(wordhash, "SIDE_BY_SIDE", long)
    w = wordhash.words_of(texts_[:-1] if long > 100 else texts_, fold=True)
    for k, i in zip(w.start.tolist(), w.end.tolist(), strict=True):
        acc = 0
        for byte in w.raw[k:i].tolist():
            acc = (acc * int(wordhash._MULTIPLY) + int(wordhash._RANDOM[byte])) % 2**64
        assert wordhash.mix(np.array([acc], dtype=np.uint64))[0] == w.hash[np.searchsorted(w.start, k)]


def test_long_words_are_quick():
    began = time.time()
    w = wordhash.words_of([b"A" * 20_000_000 + b" b", b"a" * 20_000_000], fold=True)
    assert len(w.hash) == 3 and w.hash[0] == w.hash[2] and time.time() - began < 20


@pytest.mark.parametrize("kind, ids", [("string", ["a", None, "c"]), ("struct<x:int,y:string>", [(1, "p"), None, (3, "q")]), ("decimal(20,2)", [Decimal("1.50"), None, Decimal("3.00")])])
def test_items_with_any_ids(spark, monkeypatch, kind, ids):
    items = ["one two three four five six", "seven eight nine ten eleven", "alpha beta gamma delta epsilon zeta"]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, items, strict=True)] + [(ids[0], None, "x"), (None, "...", "x")], f"item_id {kind}, question string, text string")
    df = spark.createDataFrame([("k", f"so {t} it is", 1) for t in items] + [(None, items[0], 2), ("k", "nothing here", 3), ("k", None, 4)], "key string, text string, item_id int")
    want = decontaminate.leaks(df, benchmark, "key", item_text="question").collect()
    shown = [str(r[0]) for r in spark.createDataFrame([(i,) for i in ids], f"i {kind}").collect()]
    assert sorted((str(r["key"]), str(r["item_id"])) for r in want) == sorted([("None", shown[0]), *(("k", x) for x in shown)])
    kept = decontaminate.clean(df, benchmark, item_text="question")
    assert sorted(r["item_id"] for r in kept.collect()) == [3, 4]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 30)  # each item a block of its own
    assert sorted(map(str, decontaminate.leaks(df, benchmark, "key", item_text="question").collect())) == sorted(map(str, want))
    assert decontaminate.clean(df, benchmark, item_text="question").count() == 2
    assert decontaminate.clean(df, benchmark.limit(0), item_text="question").count() == 6 and decontaminate.leaks(df, benchmark.limit(0), "key", item_text="question").count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(k if k % 9 else None, f"text {k}") for k in range(300)], "doc_id long, text string")
    placed = sharding.place(df, "doc_id", sharding.shard_names(5), 101)
    sharding.write_shards(placed, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select("doc_id", "text", "slot", "shard").collect())) == sorted(map(str, placed.select("doc_id", "text", "slot", "shard").collect()))
    folders = [f for f in (tmp_path / "s").iterdir() if f.is_dir()]
    assert len(folders) == 5 and all(1 <= len(list(f.glob("*.parquet"))) <= 3 for f in folders)


def test_stored_text_takes_names(spark):
    df = spark.createDataFrame([("é", "kept", 5), (None, "kept", 6)], "text string, media string, n_bytes int")
    out = media.store_text(df, media="wav", n_bytes="size").orderBy("n_bytes").collect()
    assert [(r["media"], r["n_bytes"], r["size"], len(r["wav"])) for r in out] == [("kept", 5, 2, 44 + 576), ("kept", 6, 0, 44 + 576)]
    assert media.store_text(df).columns == ["text", "media", "n_bytes"] and media.store_text(df.limit(0)).count() == 0


def test_training_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    a, b = (toxicity.fit(d, labels, rows=100) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]
