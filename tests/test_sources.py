"""PDF text, SQLite tables, the SQL guard, message history and embeddings."""

import json
import math
import sqlite3
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioflow.functions.text import corpus_tokens
from folioflow.operators import embedding, guard
from folioflow.plans import incremental
from folioflow.sources import pdf, readers
from folioflow.sources.sqlite import read_sqlite
from folioflow.streaming import history

# PDF


def stream(body, packed=True, extra=b""):
    data = zlib.compress(body) if packed else body
    return b"<< /Length %d%s%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if packed else b"", extra, data)


def file_of(objects):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects) + b"trailer << /Root 1 0 R >>\n%%EOF"


def book(pages, packed=True, bundle=False):
    """A file with one content stream a page; bundle: the page objects lie in an object stream."""
    n = len(pages)
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(n))
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 5 0 R >> >> >>" % (n, kids)), (5, b"<< /Type /Font /BaseFont /Helvetica >>")]
    leaves = [(10 + i, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (100 + i)) for i in range(n)]
    if bundle:
        bodies = [body for _, body in leaves]
        offsets = np.cumsum([0] + [len(b) + 1 for b in bodies])
        head = b" ".join(b"%d %d" % (num, off) for (num, _), off in zip(leaves, offsets[:-1], strict=True)) + b" "
        objects.append((50, stream(head + b" ".join(bodies), extra=b" /Type /ObjStm /N %d /First %d" % (n, len(head)))))
    else:
        objects += leaves
    return file_of(objects + [(100 + i, stream(p, packed)) for i, p in enumerate(pages)])


def shown(text):
    return b"BT /F1 12 Tf 72 700 Td " + b" ".join(b"(%s) Tj 0 -14 Td" % line.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for line in text.split("\n")) + b" ET"


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("bundle", [True, False])
def test_pdf_pages(packed, bundle):
    data = book([shown("Title (of) a page\nsecond line: café"), shown("Second page 10.1000/xyz"), shown("Third")], packed, bundle)
    n, text = pdf.probe(data)
    assert n == 3 and text == "Title (of) a page\nsecond line: café\nSecond page 10.1000/xyz"
    assert pdf.probe(book([shown("doi 10.1/x"), shown("unread")], packed, bundle)) == (2, "doi 10.1/x")
    assert pdf.whole_text(data) == "Title (of) a page second line: café Second page 10.1000/xyz Third"
    assert len(pdf.probe(book([shown("word " * 4000)], packed, bundle))[1]) == 8000
    assert pdf.whole_text(book([shown(f"p{i}") for i in range(45)])).split() == [f"p{i}" for i in range(40)]


def test_pdf_operators_and_unicode_table():
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <D55C> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0031> <0032>] endbfrange"
    page = rb"BT /F2 9 Tf <00010010> Tj [<0011> -50 <0012> -300 <0020>] TJ T* <0002> ' ET BT /F1 9 Tf (oct\101l \(nested (one)\) \
on) Tj ET"
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, b"<< /Type /Page /Contents [8 0 R 9 0 R] /Resources 4 0 R >>"), (4, b"<</Font<</F1 5 0 R/F2 6 0 R>>>>"), (5, b"<< /Type /Font >>"), (6, b"<< /Type /Font /ToUnicode 7 0 R >>"), (7, stream(table)), (8, stream(page)), (9, stream(b"BT (more) Tj ET"))]
    assert pdf.probe(file_of(objects)) == (1, "Habc 1\n한\noctAl (nested (one)) on\nmore")


def test_pdf_updates_and_broken_files():
    data = book([shown("old")])
    assert pdf.probe(data + b"100 0 obj\n" + stream(shown("new")) + b"\nendobj\n") == (1, "new")
    loop = file_of([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>"), (3, b"<< /Type /Page >>")])
    assert pdf.probe(loop) == (1, None)
    wrong_length = data.replace(b"/Length ", b"/Length 9")
    assert pdf.probe(wrong_length) == (1, "old")
    for bad in (None, b"", b"no PDF", b"%PDF-1.4", data[:60], b"%PDF" + bytes(range(256)) * 20, data.replace(b"trailer << ", b"trailer << /Encrypt 9 0 R ")):
        assert pdf.probe(bad) == (None, None)
    half = book([b"x"], packed=False).replace(b"/Length", b"/Filter /LZWDecode /Length")
    assert pdf.probe(half) == (1, None) and pdf.whole_text(half) is None
    rnd = np.random.default_rng(0)
    for _ in range(300):  # whatever is broken, nothing is raised
        b = bytearray(book([shown("some text 10.1/x (y)")], packed=False, bundle=bool(rnd.integers(2))))
        for k in rnd.integers(0, len(b), 12):
            b[k] = rnd.integers(256)
        pdf.probe(bytes(b)), pdf.whole_text(bytes(b))


def test_pdf_files_and_full_text(spark, tmp_path):
    long = "Long enough. " * 200
    (tmp_path / "a.pdf").write_bytes(book([shown("First")]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    files = readers.read_pdf_dir(spark, str(tmp_path))
    assert {(r["name"], r["page_count"], r["head"]) for r in pdf.pdf_probe(files).collect()} == {("a.pdf", 1, "First"), ("b.pdf", None, None)}
    rows = [(1, f"<a><ref-list>{long}</ref-list>{long}</a>", None, None), (2, "<a>short</a>", book([shown(long)]), f"<main>{long}</main>"), (3, None, b"broken", f"<nav>no</nav><main>{long}</main>"), (4, "x", None, "<p>y</p>"), (5, None, None, None)]
    got = {r["k"]: (r["mode"], r["text"]) for r in readers.full_text(spark.createDataFrame(rows, "k int, xml string, pdf binary, html string")).collect()}
    assert got == {1: ("xml", long.strip()), 2: ("pdf", long.strip()), 3: ("html", long.strip()), 4: ("unavailable", None), 5: ("unavailable", None)}


# SQLite


def test_sqlite_holds_conversations(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    path = str(tmp_path / "led ger#1.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE talk (conv_id BIGINT, turn INTEGER, role VARCHAR(9), text TEXT)")
    con.executemany("INSERT INTO talk VALUES (?, ?, ?, ?)", rows)
    con.execute('CREATE TABLE "odd ""name" (a INTEGER, b REAL, c BLOB, d)')
    con.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?)', [(1, 2, b"x", "y"), ("no number", "1.5", "text", 7), (None, None, None, None), (2**62, "z", b"", 1.5), (1.5, math.inf, b"\xff", b"bytes")])
    con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    con.execute("INSERT INTO keyed VALUES ('a', 1)")
    con.execute("CREATE TABLE empty_one (k TEXT)")
    con.execute("DELETE FROM talk WHERE rowid % 7 = 3")  # gaps between rowids
    left = con.execute("SELECT * FROM talk").fetchall()
    con.commit()
    con.close()
    back = read_sqlite(spark, path, "talk", tasks=5)
    assert back.rdd.getNumPartitions() == 5 and back.schema.simpleString() == "struct<conv_id:bigint,turn:bigint,role:string,text:string>"
    assert Counter(map(tuple, back.collect())) == Counter(left)
    odd = sorted(map(tuple, read_sqlite(spark, path, 'odd "name').collect()), key=str)
    assert odd == sorted([(1, 2.0, b"x", "y"), (None, 1.5, b"text", "7"), (None, None, None, None), (2**62, None, b"", "1.5"), (None, math.inf, b"\xff", None)], key=str)
    assert read_sqlite(spark, path, "keyed").collect() == [("a", 1)] and read_sqlite(spark, path, "empty_one").count() == 0
    assert read_sqlite(spark, path, "no_table", "k string, v int").collect() == [] == read_sqlite(spark, str(tmp_path / "no.db"), "talk", "k string").collect()
    assert read_sqlite(spark, path, "keyed", "v int, k string, missing double").collect() == [(1, "a", None)]
    with pytest.raises(PySparkException):
        read_sqlite(spark, path, "no_table").count()


# The guard


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT 1", "SELECT 1;", "SELECT ';' AS x -- ; drop", "/* a /* DROP TABLE t */ b */ SELECT 'delete; from t'", "SELECT `drop` FROM `insert`", "VALUES (1)", "TABLE t", "EXPLAIN SELECT 1", "DESCRIBE t", "SHOW TABLES IN a",
        "WITH x AS (SELECT 1) SELECT * FROM x JOIN t USING (a) WHERE a > (SELECT max(b) FROM s) GROUP BY a HAVING count(*) > 1 ORDER BY 1 LIMIT 5 OFFSET 2", "SELECT 'reflect(' FROM t",
        "SELECT * FROM t PIVOT (sum(a) FOR b IN (1, 2))", "SELECT sum(a) OVER w FROM t WINDOW w AS (ORDER BY b)", "SELECT * FROM t LATERAL VIEW explode(a) e AS b", "SELECT DISTINCT a FROM t UNION ALL SELECT 1 EXCEPT SELECT 2",
    ],
)
def test_queries_pass(spark, statement):
    assert guard.judge(spark, statement) == guard.Verdict("query")


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT 1; DROP TABLE x", "", "DROP TABLE t", "TRUNCATE TABLE t", "ALTER TABLE t ADD COLUMNS (a INT)", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "COPY t FROM 's'", "CREATE TABLE x AS SELECT 1",
        "WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x", "SET spark.x = 1", "CACHE TABLE t", "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1", "CALL p()", "EXECUTE IMMEDIATE 'DROP TABLE t'", "BEGIN SELECT 1; END",
        "SELECT reflect('java.lang.System', 'exit')", "SELECT * FROM t WHERE a IN (SELECT `java_method`('a', 'b'))", "INSERT INTO t SELECT builtin.reflect('a', 'b')", "SELECT TRANSFORM (a) USING 'cat' FROM t", "SELECT 1 /* open",
        "INSERT INTO other VALUES (1)", "FROM t INSERT INTO t SELECT 1 INSERT INTO other SELECT 2", "WITH x AS (SELECT 1) INSERT INTO other SELECT * FROM x", "DELETE FROM `T`.`t`",
    ],
)
def test_other_statements_are_refused(spark, statement):
    assert guard.judge(spark, statement, ("t",)).kind == "refused"


def test_writes_to_listed_tables(spark):
    go = lambda s: guard.judge(spark, s, ("ledger.Log", "t"))
    assert go("INSERT INTO ledger.log VALUES (1)") == guard.Verdict("insert", ("ledger.log",))
    assert go("WITH x AS (SELECT 1) INSERT INTO T SELECT * FROM x").kind == "insert"
    assert go("UPDATE t SET a = 1").kind == "update" and go("DELETE FROM t AS u WHERE u.a = 1").kind == "delete"
    assert not guard.read_only(spark, "DELETE FROM t") and guard.read_only(spark, "SELECT 1")
    with pytest.raises(ValueError):
        readers.sql(spark, "DROP TABLE t")
    assert readers.sql(spark, "SELECT :a AS a", a="x'; DROP TABLE t").first()[0] == "x'; DROP TABLE t"


# History


def test_replies_since(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    m = [("c", t(1), "u", "before", None, False), ("c", t(3), "u", "after", None, None), ("c", t(3), "u", "after", None, False), ("c", t(3), "v", "z", None, False), ("c", t(4), "b", "bot", None, True), ("c", t(5), "u", "", None, False), ("c", t(6), "u", None, None, False), ("d", t(9), "u", "other", None, False), (None, t(9), "u", "nowhere", None, False), ("c", t(2), "u", "the message", t(2), False)]
    messages = spark.createDataFrame(m, "channel string, ts timestamp, user string, text string, thread_ts timestamp, is_bot boolean")
    sent = spark.createDataFrame([("A", "c", t(2)), ("A", "c", t(2)), ("B", "e", t(2))], "member string, channel string, ts timestamp")
    assert [(r["member"], r["ts"], r["text"], r["since"]) for r in history.replies_since(messages, sent).collect()] == [("A", t(3), "after", t(2))]
    thread = spark.createDataFrame([("c", t(1), "u", "early in thread", t(2), False)], messages.schema)
    assert [r["text"] for r in history.replies_since(thread, sent).collect()] == ["early in thread"]


def test_deliveries_and_replay_store_each_row_once(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").dropDuplicates(["conv_id", "turn"])
    src = src.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60)).cache()
    n = src.count()
    part = lambda k: src.where(F.pmod("conv_id", F.lit(3)) == k)
    deliveries = [part(0), part(1).unionByName(part(0)), part(2).unionByName(part(2)).unionByName(part(1).limit(5))]
    into, store, log, cp = (str(tmp_path / x) for x in ("in", "store", "log", "cp"))
    schema = src.schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    for k, d in enumerate(deliveries):
        d.coalesce(1).write.mode("append").parquet(into)
        q = history.store_history(spark.readStream.schema(schema).parquet(into), store, log, cp, ["conv_id", "turn"])
        q.awaitTermination(300)
        assert history.mark(spark, log, "history") == k
    key = lambda df: Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["ts"]) for r in df.collect())
    whole = history.read_store(spark, store, ddl)
    assert whole.count() == n and key(whole) == key(src)
    # The last batch again: nothing changes. Then a reader that knows the mark reads on from there.
    history.store_batch(deliveries[2], 2, store, log, ["conv_id", "turn"])
    assert key(history.read_store(spark, store, ddl)) == key(src)
    logged = [json.loads(r["detail_json"]) for r in history.read_log(spark, log).orderBy("id").collect()]
    assert [x["stored"] for x in logged] == [part(k).count() for k in range(3)] and logged[1]["received"] == deliveries[1].count()
    assert key(history.read_since(spark, store, ddl, 1)) == key(part(2))
    late = F.lit(datetime(2023, 11, 16))
    assert key(history.read_since(spark, store, ddl, -1, since=late)) == key(src.where(F.col("ts") >= late))
    assert history.mark(spark, str(tmp_path / "none"), "history") == -1 and history.read_store(spark, str(tmp_path / "none"), ddl).count() == 0


def test_files_of_a_store_follow_its_rows_not_its_days(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k") * 43_200)
    rows = spark.range(800).select(F.col("id").alias("k"), F.lit("x").alias("text")).repartition(4).withColumn("ts", F.when(F.col("k") % 100 > 0, at))
    ddl = "k bigint, text string, ts timestamp"
    for k, batch in enumerate([rows.where("k < 500"), rows.where("k >= 300")]):
        history.store_batch(batch, k, store, log, ["k"])
    got = history.read_store(spark, store, ddl)
    # Rows without a time are stored once as well.
    assert got.columns == ["k", "text", "ts", "batch", "day"] and sorted(r["k"] for r in got.collect()) == list(range(800))
    assert got.where("day IS DISTINCT FROM to_date(ts)").count() == 0
    # 400 days lie in 15 months at most; a batch has a file a month, one more for the rows without a time.
    assert len(list((tmp_path / "store").rglob("*.parquet"))) < 2 * 17
    late = F.lit(datetime(2024, 3, 15))
    assert {r["k"] for r in history.read_since(spark, store, ddl, 0, since=late).collect()} == {r["k"] for r in rows.where((F.col("k") >= 500) & (F.col("ts") >= late)).collect()}


# Embeddings


def test_hashed_vectors_equal_plain_version_and_keep_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "zzzunknownzzz")], docs.schema)
    idf = embedding.feature_idf(docs)
    got = {r["doc_id"]: np.array(r["embedding"]) for r in embedding.hashed_vectors(docs.unionByName(odd).repartition(3), idf, "doc_id").collect()}
    assert all(not got[i].any() for i in (-1, -2, -3)) and len(got[-1]) == embedding.DIM
    rows = docs.select("doc_id", corpus_tokens("text").alias("t"), F.transform(corpus_tokens("text"), lambda t: embedding.feature(t)).alias("f")).collect()
    weight = {r["feature"]: r["idf"] for r in idf.collect()}
    n, df = sum(1 for r in rows if r["t"]), Counter(t for r in rows for t in set(r["t"]))
    exact = {}
    for r in rows:
        plain = np.zeros(embedding.DIM)
        for f, count in Counter(r["f"]).items():
            plain += count * weight[f] * embedding.signs(np.array([f]), embedding.DIM, 1)[0]
        size = np.linalg.norm(plain)
        assert np.allclose(got[r["doc_id"]], plain / size if size else plain, atol=1e-4)
        v = {t: c * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in Counter(r["t"]).items()}
        exact[r["doc_id"]] = (v, math.sqrt(sum(x * x for x in v.values())))
    ids = [i for i, (v, _) in exact.items() if v][:120]
    cos = lambda a, b: sum(x * exact[b][0].get(t, 0) for t, x in exact[a][0].items()) / exact[a][1] / exact[b][1]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k]]
    rank = lambda x: np.argsort(np.argsort(x))
    x, y = np.array([cos(a, b) for a, b in pairs]), np.array([got[a] @ got[b] for a, b in pairs])
    # Measured: 0.97 among pairs whose exact cosine is above 0.05; 0.79 over all, as the order of the 61 % below it is mostly noise.
    near = x > 0.05
    assert np.corrcoef(rank(x[near]), rank(y[near]))[0, 1] > 0.95
    assert np.corrcoef(rank(x), rank(y))[0, 1] > 0.75
    assert np.abs(x - y).mean() < 0.03


def test_embed_missing(spark):
    items = spark.createDataFrame([("a", "one two"), ("b", "two three"), ("b", None), ("c", " "), ("d", "refused"), ("e", "there is one"), (None, "no key"), ("f", "four words")], "canonical_id string, text string")
    verdicts = spark.createDataFrame([("d", False), ("a", None), ("d", False)], "canonical_id string, is_lab_relevant boolean")
    vectors = spark.createDataFrame([("e", "hash-8"), ("a", "other")], "canonical_id string, model_name string")
    model = embedding.encoder("local", {"local": embedding.local_encoder(items, dim=8)})
    go = lambda **k: sorted((r["canonical_id"], r["model_name"], len(r["embedding"])) for r in embedding.embed_missing(items, verdicts, vectors, model, **k).collect())
    assert go() == [("a", "hash-8", 8), ("b", "hash-8", 8), ("f", "hash-8", 8)]
    assert go(limit=3) == [("a", "hash-8", 8), ("b", "hash-8", 8)]  # c is one of the three


def test_remote_encoders_need_both_approvals(tmp_path):
    token = tmp_path / "token"
    some = {"jina": ("jina", lambda items, key, text: items)}
    for approved, path in ((False, None), (True, None), (True, str(token)), (False, str(token))):
        with pytest.raises(PermissionError):
            embedding.encoder("jina", some, approved, path)
    token.write_text("yes")
    assert embedding.encoder("jina", some, True, str(token)) == some["jina"]
    with pytest.raises(ValueError):
        embedding.encoder("local", some)


def test_embedding_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    docs = read("documents").select("doc_id", "text", F.transform(corpus_tokens("text"), lambda t: embedding.feature(t)).alias("f")).collect()
    toxic = {r["doc_id"] for r in read("labels").collect() if r["toxic"] == 1}
    have = {r["vec_id"] for r in read("embeddings").collect() if r["vec_id"] % 2 == 0}
    n, df = sum(1 for r in docs if (r["text"] or "").strip()), Counter(f for r in docs for f in set(r["f"] or []))
    got = {r["doc_id"]: np.array(r["embedding"]) for r in incremental.embedding_job(spark, sf).collect()}
    assert set(got) == {r["doc_id"] for r in docs if r["doc_id"] not in toxic | have and (r["text"] or "").strip()}
    for r in docs[::7]:
        if r["doc_id"] in got:
            plain = sum(c * (math.log((n + 1) / (df[f] + 1)) + 1) * embedding.signs(np.array([f]), embedding.DIM, 1)[0] for f, c in Counter(r["f"]).items())
            assert np.allclose(got[r["doc_id"]], plain / np.linalg.norm(plain), atol=1e-4)
