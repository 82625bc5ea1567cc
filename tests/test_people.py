"""Sessions, profiles, drafts, reports and readers on hand-made rows."""

import difflib
import json
import random

from pyspark.sql import functions as F

from folioflow.operators import drafts, merge, profiles, reports, sessions
from folioflow.sources import readers


def test_handshake_refuses_what_was_not_issued(spark):
    log = [("i", "a"), ("a", "b"), ("a", "a"), ("a", "a"), ("i", "c"), ("i", None), ("a", "c"), ("a", None), ("i", "d"), ("a", "d")]
    rows = [("s", i, "issue" if k == "i" else "answer", item) for i, (k, item) in enumerate(log)] + [("t", 0, "answer", "a")]
    out = sessions.handshake(spark.createDataFrame(rows, "session_id string, n int, kind string, item string"), ["n"])
    got = {(r.session_id, r.n): r.accepted for r in out.collect()}
    assert [n for n in range(len(log)) if got["s", n]] == [2, 9]
    assert got["t", 0] is False and got["s", 0] is None


def test_sessions_are_reused_and_closed_once(spark):
    s = spark.createDataFrame([("u", "s1", 1, None), ("u", "s2", 2, None), ("v", "s3", 1, 5)], "user string, session_id string, started_at int, completed_at int")
    users = spark.createDataFrame([("u",), ("v",), ("w",)], "user string")
    got = {r.user: (r.session_id, r.reused) for r in sessions.open_or_reuse(users, s, F.concat(F.lit("new-"), "user")).collect()}
    assert got == {"u": ("s2", True), "v": ("new-v", False), "w": ("new-w", False)}
    done = spark.createDataFrame([("s1", 9), ("s3", 9)], "session_id string, at int")
    assert {r.session_id: r.completed_at for r in sessions.close(s, done).collect()} == {"s1": 9, "s2": None, "s3": 5}


def test_project_weights(spark):
    cases = [([1.0, 3.0], 2, [0.25, 0.75]), ([1.0], 2, [0.5, 0.5]), ([0.0, 0.0], 2, [0.5, 0.5]), ([-1.0, 2.0], 2, [0.5, 0.5]), ([None, 1.0], 2, [0.5, 0.5]), (None, 2, [0.5, 0.5]), ([], 0, [])]
    df = spark.createDataFrame([(i, w, n) for i, (w, n, _) in enumerate(cases)], "i int, w array<double>, n int")
    got = {r.i: r.o for r in df.select("i", profiles.project_weights("w", "n").alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_fingerprint_fills_up_only_the_poor(spark):
    hits = spark.createDataFrame([("rich", p, 1.0) for p in "abcd"] + [("poor", "Memory", 1.0)], "user string, phrase string, score double")
    salvage = spark.createDataFrame([(u, p, 0.5) for u in ("rich", "poor", "none") for p in ("memory", "noise")], "user string, phrase string, score double")
    got = {}
    for r in profiles.fingerprint(hits, salvage).orderBy("user", "rank").collect():
        got.setdefault(r.user, []).append(r.phrase)
    assert got == {"rich": list("abcd"), "poor": ["Memory", "noise"], "none": ["memory", "noise"]}


def test_embed_in_batches(spark):
    seen = spark.createDataFrame([(i, "x" * i if i else None) for i in range(40)], "canonical_id bigint, text string").repartition(3)

    def load():
        def encode(texts):
            assert len(texts) <= 16
            return [[len(t), 1.0] for t in texts]

        return encode

    assert {r.canonical_id: r.embedding for r in profiles.embed(seen, load).collect()} == {i: [float(i), 1.0] for i in range(40)}


def test_barred_equals_all_pairs(spark):
    rng = random.Random(3)
    words = "neural coding of visual working memory in human cortex under load".split()
    base = [" ".join(rng.sample(words, 6)) for _ in range(12)]

    def near(t):
        cut = rng.randrange(len(t))
        return t[:cut] + rng.choice("xyz ") + t[cut + rng.choice((0, 1, 3)) :]

    cands = [(u, f"10.1/{u}{i}", near(t)) for u in "pq" for i, t in enumerate(base)]
    titles = [("p", t.upper()) for t in base[::2]] + [("q", base[1]), ("q", ""), ("q", None)]
    got = drafts.barred(
        spark.createDataFrame(cands + [("p", "10.1/none", None)], "unit string, doi string, title string"), spark.createDataFrame([("p", "https://doi.org/10.1/P1")], "unit string, doi string"), spark.createDataFrame(titles, "unit string, title string")
    )
    clean = lambda t: " ".join((t or "").lower().split())
    want = {(u, d) for u, d, t in cands for v, s in titles if u == v and clean(s) and difflib.SequenceMatcher(None, clean(t), clean(s)).ratio() >= 0.9}
    rows = {(r.unit, r.doi): r.why for r in got.collect()}
    assert set(rows) == want | {("p", "10.1/p1")} and len(want) > 3
    assert rows["p", "10.1/p1"] == "doi"


def test_preview_names_what_is_wrong(spark):
    df = spark.createDataFrame([("u", "10.1/a", "a Stupid one"), ("v", None, "fine")], "unit string, doi string, body string")
    got = {r.unit: (r.n_chars, r.banned, r.missing) for r in drafts.preview(df, ["doi"], ["stupid"]).collect()}
    assert got == {"u": (10, ["stupid"], []), "v": (4, [], ["doi"])}


def test_nested_is_null_only_if_all_probes_are(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "x", None, None)], "k int, s_a string, s_b string, s_c int")
    assert {r.k: r.s for r in reports.nested(df, "s_", "s", ["a", "b"]).collect()} == {1: None, 2: ("x", None, None)}


def test_digest_ignores_order_and_sees_every_change(spark):
    rows = [("g", i, f"t{i}") for i in range(20)]
    digest = lambda r: reports.table_digest(spark.createDataFrame(r, "g string, i int, t string"), "g", ["i", "t"]).first().digest
    assert digest(rows) == digest(rows[::-1])
    assert len({digest(rows), digest(rows[1:]), digest(rows + rows[:1]), digest([("g", 0, "u0")] + rows[1:])}) == 4


def test_files_and_writes(spark, tmp_path):
    (tmp_path / "pdf" / "sub").mkdir(parents=True)
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Page\n /Type /Pages /Type/Page ")
    (tmp_path / "pdf" / "sub" / "b.PDF").write_bytes(b"broken")
    (tmp_path / "pdf" / ".hidden.pdf").write_bytes(b"x")
    files = readers.read_pdf_dir(spark, str(tmp_path / "pdf"))
    assert sorted(r.name for r in files.collect()) == ["a.pdf", "b.PDF"]

    df = spark.createDataFrame([("a b", 1), (None, 2)], "t string, n int")
    readers.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(readers.read_jsonl(spark, str(tmp_path / "out"), "t string, n int").collect(), key=str) == sorted(df.collect(), key=str)
    assert {json.loads(r.row)["n"] for r in readers.as_json_rows(df).collect()} == {1, 2}

    path = str(tmp_path / "groups")
    merge.overwrite_groups(spark.createDataFrame([("a", 1), ("b", 1)], "g string, n int"), path, "g")
    merge.overwrite_groups(spark.createDataFrame([("b", 2)], "g string, n int"), path, "g")
    assert {(r.g, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
