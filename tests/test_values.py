"""JSON values, typed counters and rolling rates against plain versions."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.functions.json_values import parsed_or, parsed_or_text, string_leaves
from folioflow.operators import feedback, typed
from folioflow.streaming import streams


def plain_leaves(x, left=4):
    if isinstance(x, str):
        return [x]
    if isinstance(x, list):
        return [s for y in x for s in plain_leaves(y, left - 1)]
    if isinstance(x, dict) and left > 0:
        return [s for y in x.values() for s in plain_leaves(y, left - 1)]
    return []


def grown(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.3:
        return rnd.choice(['a"b\\', "é\n{[]}:", "", "x: y", 1, 2.5, None, True, "\\u0041", "😀"])
    if kind < 0.6:
        return [grown(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["k", "b", "a:", '"', "z{"]) + str(i): grown(rnd, depth - 1) for i in range(rnd.randint(0, 3))}


def test_leaves_equal_plain_version(spark):
    rnd = random.Random(6)
    values = [grown(rnd, 7) for _ in range(250)] + [[[[[["deep list"]]]]], {"a": {"b": {"c": {"d": {"e": "gone"}, "f": "kept"}}}}, ["x" * 200_000]]
    texts = [json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None) for i, v in enumerate(values)]
    want = [plain_leaves(v) for v in values]
    texts += [None, "", "not JSON", '{"a": "b"', '["a",]']
    want += [[]] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(3)
    got = dict(df.select("i", string_leaves("x").alias("l")).collect())
    for i, leaves in enumerate(want):
        assert got[i] == leaves, texts[i]
    assert "Python" not in df.select(string_leaves("x"))._jdf.queryExecution().executedPlan().toString()
    assert spark.createDataFrame([('{"a": {"b": "x"}}',)], "x string").select(string_leaves("x", 1)).first()[0] == []


def test_parsed_or_default(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("no",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(F.to_json(parsed_or("x", '{"k": 0}'))).collect()] == ['{"k":1}', '{"k":0}', '{"k":0}', '{"k":0}']
    assert [r[0] for r in df.select(F.to_json(parsed_or_text("x"))).collect()] == ['{"k":1}', '"no"', None, '""']


def plain_counts(projects):
    out = Counter()
    for user, text in projects:
        try:
            v = json.loads(text)
        except (TypeError, ValueError):
            continue
        names = {}
        for field, kind in (("independent_vars", "iv"), ("dependent_vars", "dv")):
            names[kind] = []
            items = v.get(field) if isinstance(v, dict) else None
            for x in items if isinstance(items, list) else []:
                name = x if isinstance(x, str) else x.get("name") if isinstance(x, dict) else None
                if isinstance(x, str) or name:
                    names[kind].append(name)
                    out[user, f"{kind}_name", name] += 1
                values = x.get("values") if isinstance(x, dict) and kind == "iv" else None
                for y in values if isinstance(values, list) else []:
                    out[user, "iv_value", y if isinstance(y, str) else json.dumps(y, separators=(",", ":"))] += 1
        for c in {f"{i}+{d}" for i in names["iv"] for d in names["dv"]}:
            out[user, "compound", c] += 1
    return out


def test_typed_counts_equal_plain_version(spark):
    rnd = random.Random(8)

    def variable():
        name = rnd.choice(["a", "b", "", None])
        return rnd.choice([rnd.choice(["a", "c", ""]), {"name": name}, {"name": name, "values": [1, "x", True, None, [1, "y"], {"z": 2}]}, {"values": "no list"}, 5, None, ["a"]])

    projects = []
    for i in range(200):
        v = {f: rnd.choice([[variable() for _ in range(rnd.randint(0, 4))], None, "text", {"a": 1}]) for f in ("independent_vars", "dependent_vars")}
        projects.append((rnd.choice(["u", "v", None]), rnd.choice([json.dumps(v)] * 8 + [None, "no JSON", "[1]"])))
    df = spark.createDataFrame(projects, "user string, variables string").repartition(3)
    got = {(r["user"], r["kind"], r["key"]): r["n"] for r in typed.typed_counts(df).collect()}
    assert got == plain_counts(projects)
    assert typed.typed_counts(df.limit(0)).count() == 0


def answers_of(rnd, n, days):
    begin = datetime(2024, 1, 1)
    choices = ["save_later", "not_relevant", "already_read", "skipped", None]
    return [(rnd.choice([1, 1, 1, 2, None]), begin + timedelta(seconds=rnd.randrange(days * 86400)), rnd.choice(choices)) for _ in range(n)]


SCHEMA = "user long, ts timestamp, choice string"


def plain_rolling(rows, days=30):
    out = {}
    for user, day in {(u, t.date()) for u, t, _ in rows}:
        inside = [c for u, t, c in rows if u == user and day - timedelta(days=days - 1) <= t.date() <= day]
        out[user, day] = (len(inside), inside.count("save_later"), inside.count("not_relevant"), inside.count("already_read"))
    return out


@pytest.mark.parametrize("days", [1, 30])
def test_rolling_rates_equal_plain_version(spark, days):
    rows = answers_of(random.Random(days), 400, 100)
    df = spark.createDataFrame([*rows, (1, None, "save_later")], SCHEMA).repartition(3)
    got = {(r["user"], r["day"]): (r["n"], r["saved"], r["rejected"], r["read"]) for r in feedback.rolling_rates(df, days).collect()}
    assert got == plain_rolling(rows, days)
    assert feedback.rolling_rates(df.limit(0)).count() == 0


def test_flags_and_lookback(spark):
    now = datetime(2024, 3, 1)
    at = lambda d: now - timedelta(days=d)
    rows = [(1, at(d), "save_later") for d in (1, 2, 3)] + [(1, at(5), "not_relevant")] * 7 + [(1, at(30), "already_read"), (1, at(31), "save_later"), (1, at(0), "save_later"), (2, at(40), "skipped")]
    got = {r["user"]: r for r in feedback.lookback(spark.createDataFrame(rows, SCHEMA), F.lit(now)).collect()}
    assert (got[1]["n_all"], got[1]["n"], got[1]["precision"], got[1]["flags"]) == (13, 11, 0.3, ["low_precision"])
    assert (got[2]["n_all"], got[2]["n"], got[2]["precision"], got[2]["read_rate"], got[2]["flags"]) == (1, 0, None, None, [])


def test_rolling_stream_equals_batch(spark, tmp_path):
    """Three deliveries; rows up to a day late count, and the windows of days with answers are those of the batch."""
    rnd = random.Random(9)
    rows = sorted(answers_of(rnd, 300, 60), key=lambda r: r[1])
    cut = [rows[:100], rows[100:200], rows[200:]]
    late = [r for r in cut[0] if r[1] > cut[0][-1][1] - timedelta(hours=20)][:5]
    cut = [[r for r in cut[0] if r not in late], late + cut[1], [*cut[2], (99, datetime(2024, 6, 1), "skipped")]]  # the last moves the watermark on
    for k, part in enumerate(cut):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.rolling_rates(stream).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    seen = {(r["user"], r["day"]): (r["n"], r["saved"], r["rejected"], r["read"]) for r in spark.table("rolled").collect()}
    want = plain_rolling(rows)
    assert want and {k: seen.get(k) for k in want} == want
    assert len(seen) > len(want)  # days on which earlier answers still count
