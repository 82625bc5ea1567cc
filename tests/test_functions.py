"""Functions and operators on hand-made rows: the cases that are easy to get wrong."""

import difflib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.functions import dates as D
from folioflow.functions import scoring as S
from folioflow.functions import text as X
from folioflow.operators import dq, feedback, filters, lexical, merge, ranking, resolve
from folioflow.sources import readers
from folioflow.streaming import streams


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string') if not isinstance(v, list) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, doi",
    [("https://doi.org/10.1/AbC.", "10.1/abc"), ("http://dx.doi.org/10.1/x);", "10.1/x"), ("doi:10.1/x", "doi:10.1/x"), ("", None), (None, None), ("10.1/a),", "10.1/a")],
)
def test_norm_doi(spark, raw, doi):
    assert one(spark, X.norm_doi("x"), x=raw) == doi


def test_ledger_doi(spark):
    assert one(spark, X.doi_normalize("x"), x=" https://doi.org/DOI:10.1/X. ") == "10.1/x."


def test_extract_doi(spark):
    assert one(spark, X.extract_doi("x"), x="see (10.1234/abc.def), there") == "10.1234/abc.def"


def test_norm_title(spark):
    assert one(spark, X.norm_title("x"), x="Bayés: A—Test 2!") == "bayesatest2"
    assert one(spark, X.norm_title("x"), x="시각 A") != "a"
    assert one(spark, X.norm_title("x"), x=None) is None


def test_canonical_id(spark):
    import hashlib

    assert one(spark, X.canonical_id(F.col("d"), F.col("t"), F.col("y")), d="10.1/X", t="t", y=0) == hashlib.sha256(b"doi:10.1/x").hexdigest()[:32]
    assert one(spark, X.canonical_id(F.col("d"), F.col("t"), F.col("y")), d=None, t="abc", y=0) == hashlib.sha256(b"ttl:abc|").hexdigest()[:32]


def test_counts(spark):
    assert one(spark, X.count_of(F.col("x"), F.lit("aa")), x="aaaaa") == 2
    assert one(spark, X.token_count("x"), x="a　b c") == 3
    assert one(spark, X.token_count("x"), x="") == 1


def test_filename(spark):
    r = one(spark, X.parse_filename("x"), x="/a/b/Smith_2019_On_things.pdf")
    assert (r.author, r.year, r.title, r.truncated) == ("Smith", 2019, "On things", False)
    assert one(spark, X.parse_filename("x"), x="cortex.pdf").truncated


def test_inverted_index_of_whole_texts(spark):
    rng = random.Random(2)
    lists = [[], [""], ["a"], ["a"] * 30, [f"w{rng.randrange(9)}" for _ in range(200)], [f"w{k // 2}" for k in range(20_000)], None]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, w array<string>").withColumn("m", X.inverted_index("w"))
    for r in df.select("k", "m", X.inverted_index_text("m").alias("t")).collect():
        if (w := lists[r.k]) is None:
            assert r.m is None and r.t is None
        else:
            assert all(ps == sorted(ps) for ps in r.m.values())
            assert sorted((p, x) for x, ps in r.m.items() for p in ps) == list(enumerate(w)) and r.t == " ".join(w)


def test_inverted_index_whole_keeps_late_words(spark, tmp_path):
    from folioflow.plans import registry

    rows = [(1, " ".join(f"w{k % 30}" for k in range(75))), (1, "again  the\n same id"), (None, "x " * 25), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["inverted_index_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.words) for r in got), key=str) == sorted(((i, None if t is None else " ".join(t.split())) for i, t in rows), key=str)
    postings = registry.QUERIES["inverted_index_whole"](spark, str(tmp_path)).collect()
    want = [(i, w, t.split().count(w), ",".join(str(k) for k, x in enumerate(t.split()) if x == w)) for i, t in rows if t for w in set(t.split())] + [(4, "", 1, "0")]
    assert sorted(map(tuple, postings), key=str) == sorted(want, key=str)


def test_inverted_index(spark):
    df = spark.sql("SELECT map('a', array(0, 5), 'b', array(2), 'c', array(2)) AS m, CAST(NULL AS map<string,array<int>>) AS n")
    assert tuple(df.select(X.inverted_index_text("m"), X.inverted_index_text("n")).first()) == ("a c a", None)


def test_ratios(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))), "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))) for _ in range(60)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    got = spark.createDataFrame(pairs, "a string, b string").select(X.indel_ratio("a", "b"), X.matching_blocks_ratio("a", "b")).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert math.isclose(r[0], 2 * lcs(a, b) / (len(a) + len(b)))
        assert math.isclose(r[1], difflib.SequenceMatcher(None, a, b).ratio())


def test_html_main(spark):
    long = "word " * 300
    page = lambda x: one(spark, X.html_main("x"), x=x)
    assert page(f"<html><body><nav>menu</nav><article>Main <b>text</b><script>x()</script> {long}<footer>f</footer></article>foot</body></html>") == ("Main text " + long).strip()
    assert page("<html><head><title>t</title></head><body><nav>menu</nav><article>Short <b>text</b><style>x</style></article>rest<footer>f</footer></body></html>") == "Short text rest"
    assert page(f"<body><article>short</article><div role='main'>{long}<ul class='a references'>gone</ul></div><main>{long} other</main></body>") == long.strip()
    assert page(f"<body><nav><div id=content>{long}</div></nav></body>") == long.strip()  # what is around a place doesn't count
    assert page(f"<body><div class='x c-article-body'><nav>{long}</nav>left</div>b</body>") == "left"  # measured with what is taken out
    assert page("a <b>bare</b> page &amp; &eacute;<br>x") == "a bare page & é x" and page("") == "" and page(None) is None
    assert page("<body><p>unclosed <div>x</body>after") == "unclosed x" and page("<body></i>stray</body>") == "stray"


def test_dates(spark):
    assert str(one(spark, D.flexible_date("x"), x="2020-05")) == "2020-05-01"
    assert one(spark, D.flexible_date("x"), x="soon") is None
    for year, want in ((2030, "recent"), (2022, "recent"), (2021, "mid"), (2016, "classic"), (0, "classic")):
        assert one(spark, D.age_chunk("y", F.lit(None).cast("string"), 2026), y=year) == want


def test_cycle_border(spark):
    ts = lambda s: D.cycle_id(F.lit(s).cast("timestamp"))
    assert one(spark, ts("2024-01-05 04:59:59"), x="") == "20231229-1400"
    assert one(spark, ts("2024-01-05 05:00:00"), x="") == "20240105-1400"


def test_composites(spark):
    assert math.isclose(one(spark, S.composite_plain("c", "d", "n"), c=-0.5, d=0.5, n=7), 0.3 * 0.5 + 0.15)
    k = math.tanh(10 / 25)
    want = (1 - math.exp(-3 * max(0.4, k))) * (0.45 * 0.4 + 0.2 * 0.5 + 0.3 * k + 0.05)
    assert math.isclose(one(spark, S.composite_phrases("c", "d", "n", "k"), c=0.4, d=0.5, n=1, k=10.0), want)
    assert math.isclose(one(spark, S.rrf("a", "b", "c"), a=1, b=2, c=3), (1 / 61 + 1 / 62 + 1 / 63) * 20)


def test_percentile_tier_counts_within_the_cut(spark):
    df = spark.createDataFrame([(i, 1.0 - i / 100, 0.5 if i else 0.2) for i in range(20)], "i int, s double, c double")
    got = {r.i: r.t for r in df.select("i", S.percentile_tier("s", "c").alias("t")).collect()}
    assert got[0] == "A" and got[3] == "A" and got[4] == "B" and got[9] == "B" and got[10] == "C"


def test_auto_mode_and_floors(spark):
    one_phrase = "array(named_struct('phrase', 'x', 'score', 1.0D))"
    none = "CAST(array() AS array<struct<phrase:string,score:double>>)"
    df = spark.sql(f"SELECT 'u' AS user, 1 AS item, 'recent' AS chunk, array(1.0, 0.0) AS embedding, array(0.1, 1.0) AS query, 'x' AS text, {one_phrase} AS phrases, 0.0D AS dim, 0 AS n_combos UNION ALL SELECT 'v', 1, 'recent', array(1.0, 0.0), array(0.1, 1.0), 'x', {none}, 0.0D, 0")
    assert [r.user for r in ranking.score(df, "auto").collect()] == ["u"]
    assert ranking.score(df, "plain").count() == 0


@pytest.mark.parametrize(
    "pages, title, doi, want",
    [(299, "x", None, False), (300, "x", None, True), (None, "A primer on x", None, True), (None, "x", "10.4324/1", True), (None, "x", "10.31234/osf", False), (300, "x", "10.31234/osf", True)],
)
def test_textbook(spark, pages, title, doi, want):
    df = spark.createDataFrame([(pages, title, doi)], "p int, t string, d string")
    assert df.select(filters.is_textbook("p", "t", "d")).first()[0] is want


def test_review_and_meeting(spark):
    df = spark.createDataFrame([("Reviewer #2", None), ("A review", "review"), ("x", "peer-review"), ("P123: x", None)], "t string, k string")
    got = df.select(filters.is_review_doc("t", "k"), filters.is_meeting_abstract("t", F.lit(None).cast("string"), "k", F.lit(None).cast("string"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (True, False), (False, True)]


def test_match_kinds(spark):
    df = spark.createDataFrame([("RSA",), ("model comparison",), ("기억",), ("memory",)], "t string")
    assert [r[0] for r in df.select(lexical.match_kind("t")).collect()] == ["word", "sub", "sub", "sub"]


def test_exclusion_score(spark):
    s = filters.exclusion_score("t", "a", ["neuron"], ["battery", "wildlife"])
    verdict = lambda t, a: one(spark, s, t=t, a=a).verdict
    assert verdict("battery", "") == "oos_template" and verdict("battery neuron", "wildlife") == "agent_fanout" and verdict("Retracted: neuron", "") == "oos_template" and verdict("x", "") == "agent_fanout"


def records(spark, rows):
    return spark.createDataFrame(rows, "canonical_id string, title_norm string, title string, year int, is_preprint boolean, abstract string, doi string, seq int")


def brute_greedy(rows, least=0.92):
    out = {}
    for year in {r[3] for r in rows if r[3] is not None}:
        kept = []
        for r in sorted([r for r in rows if r[3] == year and r[1]], key=lambda r: (-len(r[2]), r[0])):
            for k in kept:
                if 2 * X._lcs(r[1], k[1]) / (len(r[1]) + len(k[1])) >= least:
                    out[r[0]] = k[0]
                    break
            else:
                kept.append(r)
    return out


def test_fuzzy_passes_lose_nothing(spark):
    rng = random.Random(3)
    rows = []
    for b in range(25):
        base = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(26, 70)))
        for v in range(4):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice("abcdefgh")
            key = "".join(t)
            rows.append((f"{b:03d}{v}", key, key, 2010 + v % 2, v == 3, "x", None, len(rows)))
    df = records(spark, rows)
    assert {r.alias: r.keeper for r in resolve.fuzzy_within_year(df).collect()} == brute_greedy(rows)
    want = {}
    for p in rows:
        if p[4] and len(p[1]) >= 25:
            fit = [q for q in rows if not q[4] and 2 * X._lcs(p[1], q[1]) / (len(p[1]) + len(q[1])) >= 0.88]
            if fit:
                want[p[0]] = min(fit, key=lambda q: q[7])[0]
    assert {r.alias: r.keeper for r in resolve.fuzzy_preprint(df).collect()} == want


def test_title_collapse_gap(spark):
    t = "a" * 25
    df = records(spark, [("1", t, t, 2010, True, "", None, 0), ("2", t, t, 2014, False, "", None, 1), ("3", t, t, 2003, False, "", None, 2), ("4", t[:24], t, 2014, False, "", None, 3)])
    assert [(r.alias, r.keeper) for r in resolve.title_collapse(df).collect()] == [("1", "2")]


def test_aliases_close(spark):
    df = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "alias string, keeper string")
    assert {r.keeper for r in resolve.close_aliases(df).collect()} == {"9"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "bb", 5)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "b", None), (3, "c", 1)], "k int, s string, n int")
    go = lambda a: merge.upsert(a, new, ["k"], {"s": "longer", "n": "coalesce"})
    once = sorted(map(tuple, go(old).collect()))
    assert once == [(1, "a", None), (2, "bb", 5), (3, "c", 1)] and sorted(map(tuple, go(go(old)).collect())) == once


def test_belief_limits(spark):
    prefs = spark.createDataFrame([("u", "a", 0.45), ("u", "b", 0.9), ("u", "c", 0.2)], "user string, code string, weight double")
    tags = spark.createDataFrame([("u", c, ch, r) for c, ch, r in [("a", "save_later", False)] * 3 + [("b", "save_later", False)] * 3 + [("c", "not_relevant", True)] * 3], "user string, code string, choice string, reason boolean")
    got = {r.code: round(r.new_weight, 6) for r in feedback.belief_update(prefs, tags).collect()}
    assert got == {"a": 0.65, "b": 0.9, "c": 0.1}


def test_coverage(spark):
    df = spark.createDataFrame([("-1",), ("1.5",), ("NaN",), ("0.9",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(dq.coverage("x")).collect()] == [0.0, 1.0, None, 0.9, None, None]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": "one two"}\n\n{"a": "three"}\r\n', encoding="utf-8")
    assert sorted(r.a for r in readers.read_jsonl(spark, f"file://{p}", "a string").collect() if r.a) == ["one two", "three"]
    assert readers.read_jsonl(spark, f"file://{tmp_path}/none", "a string").count() == 0


def test_csv_and_json_dir(spark, tmp_path):
    (tmp_path / "r.csv").write_text("source_file,confirmed\na,1\nb,0\nc,x\nd,\n")
    assert [r.source_file for r in readers.read_confirmed_csv(spark, str(tmp_path / "r.csv")).collect()] == ["a"]
    d = tmp_path / "j"
    d.mkdir()
    (d / "k1.json").write_text('{"canonical_id": "k1", "coverage": "0.5"}')
    (d / "k2.json").write_text('{"canonical_id": "other"}')
    (d / "k3.json").write_text("{broken")
    good, bad = readers.read_json_dir(spark, str(d))
    assert sorted(r.canonical_id for r in good.collect()) == ["k1", "k2"] and {r["_key"] for r in bad.collect()} == {"k2", "k3"}


def test_conversation_deadlines():
    t = datetime(2024, 1, 5, 5)
    h = lambda n: t + timedelta(hours=n)
    end = h(1000)
    assert streams.run_conversation(t, [], end) == ("timeout", 0)
    assert streams.run_conversation(t, [(h(30), "saved", False)], end) == ("decided", 1)
    assert streams.run_conversation(t, [(h(50), "saved", False)], end) == ("timeout", 0)
    assert streams.run_conversation(t, [(h(1), "thread_reply", False)], h(12)) == ("awaiting_decision", 1)
    assert streams.run_conversation(t, [(h(1), "thread_reply", False)], end) == ("timeout", 1)
    assert streams.run_conversation(t, [(h(1), "thread_reply", False), (h(2), "thumbs_down", True)], end) == ("decided", 2)


def test_reviews_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(u, datetime(2024, 1, 1) + timedelta(minutes=i), i, rng.choice(["save_later", "not_relevant", "skipped"])) for i in range(90) for u in (1, 2)]
    df = spark.createDataFrame(rows, "user long, ts timestamp, event_id long, choice string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.reviews_stream(stream).writeStream.format("memory").queryName("reviews").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = feedback.review_windows(df, "user", ["ts", "event_id"])
    assert sorted(map(tuple, spark.table("reviews").collect())) == sorted(map(tuple, batch.collect()))


def test_conversations_stream(spark, tmp_path):
    start = datetime(2024, 1, 5, 6)
    rows = [(1, start, "saved", False, "a"), (1, start, "saved", False, "a"), (2, start + timedelta(hours=1), "thread_reply", False, "b"), (2, start + timedelta(hours=3), "thumbs_down", False, "c")]
    df = spark.createDataFrame(rows, "member long, ts timestamp, signal string, picked boolean, idem_key string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.conversations_stream(stream).writeStream.format("memory").queryName("talks").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.member: (r.state, r.reply_count) for r in spark.table("talks").collect()}
    want = {r.member: (r.state, r.reply_count) for r in streams.conversations_batch(df, datetime(2024, 1, 5, 10)).collect()}
    assert last == want == {1: ("decided", 1), 2: ("passed", 2)}


def test_conversations_stream_deadlines(spark, tmp_path):
    """Deadlines that the watermark jumps over, late replies, and conversations whose week is over: as the batch form at the end."""
    friday = datetime(2024, 1, 5, 6)
    h = lambda n: friday + timedelta(hours=n)
    steps = [
        [(1, h(30), "thread_reply", False, "a"), (2, h(1), "thread_reply", False, "b"), (3, h(2), "saved", False, "c")],
        [(3, h(5), "thumbs_down", False, "d"), (1, h(31), "thread_reply", True, "e"), (9, h(24 * 30), "saved", False, "f")],
        [(9, h(24 * 31), "saved", False, "g")],
        [(9, h(24 * 32), "saved", False, "h")],
    ]
    schema = "member long, ts timestamp, signal string, picked boolean, idem_key string"
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sink = streams.conversations_stream(stream).writeStream.foreachBatch(lambda df, i, k=k: df.write.mode("append").parquet(str(tmp_path / f"out{k}")))
        sink.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    last = {}
    for k in range(len(steps)):
        out = tmp_path / f"out{k}"
        for r in spark.read.schema("member long, cycle string, state string, reply_count int").parquet(str(out)).collect() if out.exists() else []:
            last[r.member, r.cycle] = max(last.get((r.member, r.cycle), (0, "")), (r.reply_count, r.state), key=lambda x: (x[0], x[1] in ("timeout", "decided", "passed")))
    df = spark.createDataFrame([r for rows in steps for r in rows], schema)
    want = {(r.member, r.cycle): (r.reply_count, r.state) for r in streams.conversations_batch(df, h(24 * 33)).collect() if r.member < 9}
    assert {k: v for k, v in last.items() if k[0] < 9} == want
    assert sorted(v for v in want.values()) == [(1, "decided"), (1, "timeout"), (2, "decided")]


def test_batch_conversations_equal_plain_python(spark):
    import random

    rng = random.Random(5)
    signals = [*streams.AFTER, "other"]
    start = datetime(2024, 1, 5, 5)
    rows = [(rng.randrange(40), start + timedelta(minutes=rng.randrange(7 * 24 * 60)), rng.choice(signals), rng.random() < 0.1, f"k{rng.randrange(300)}") for _ in range(400)]
    rows = list({r[4]: r for r in rows}.values())
    as_of = start + timedelta(days=6)
    got = {r.member: (r.state, r.reply_count) for r in streams.conversations_batch(spark.createDataFrame(rows, "member long, ts timestamp, signal string, picked boolean, idem_key string"), as_of).collect()}
    want = {m: streams.run_conversation(start, [(ts, s, p) for n, ts, s, p, _ in rows if n == m], as_of) for m in {r[0] for r in rows}}
    assert got == want


def test_close_aliases_long_chains_and_circles(spark):
    chain = [(f"{k:05d}", f"{k + 1:05d}") for k in range(700)]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("self", "self")]
    got = {r.alias: r.keeper for r in resolve.close_aliases(spark.createDataFrame(chain + circle, "alias string, keeper string")).collect()}
    assert got == {a: "00700" for a, _ in chain} | {"y": "x", "z": "x"}


def test_ranked_by_many_tasks(spark):
    import random

    from folioflow.operators import ranking

    rng = random.Random(6)
    rows = [(u, i, rng.choice([0.0, 0.0, round(rng.random(), 1)])) for u in range(3) for i in range(400)]
    got = ranking.ranked(spark.createDataFrame(rows, "user int, item int, x double"), "user", [F.desc("x"), F.col("item")], "r", 7).collect()
    want = {(u, i): k for u in range(3) for k, (_, i) in enumerate(sorted((-x, i) for v, i, x in rows if v == u), 1)}
    assert {(r.user, r.item): r.r for r in got} == want


def test_users_in_blocks(spark):
    from folioflow.operators import ranking

    items = spark.createDataFrame([(k, f"word{k} alpha", [1.0, float(k)]) for k in range(6)], "item int, text string, embedding array<double>")
    users = spark.createDataFrame([(u, [1.0, 0.5], [(f"word{u}", 2.0), ("alpha", 1.0)]) for u in range(5)], "user int, query array<double>, phrases array<struct<phrase:string,score:double>>")
    whole, parts = (sorted(map(str, ranking.pairs(items, users, block).collect())) for block in (500, 2))
    assert len(whole) == 30 and whole == parts
