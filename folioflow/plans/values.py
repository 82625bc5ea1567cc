"""Queries on values inside rows: JSON, variants, rounding, rolling rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.json_values import parsed_or_text, string_leaves
from folioflow.functions.rounding import half_even
from folioflow.operators import feedback, typed
from folioflow.plans.base import ANSWERS, answers, table


def rolling_rates(spark: SparkSession, d: str) -> DataFrame:
    """Thirty days that end with each day on which a user answered."""
    r = feedback.rolling_rates(answers(spark, d))
    return r.select("user", F.col("day").cast("string").alias("day"), *feedback.COUNTS, half_even("precision", 6).alias("precision"), half_even("read_rate", 6).alias("read_rate"), F.array_join("flags", ",").alias("flags"))


SQL_RATES = """round(saved / nullif(saved + rejected, 0), 6) AS precision, round(read / nullif(n, 0), 6) AS read_rate,
  concat_ws(',', CASE WHEN n >= 10 AND saved / nullif(saved + rejected, 0) < 0.45 THEN 'low_precision' END, CASE WHEN n >= 10 AND read / n > 0.40 THEN 'high_read_rate' END) AS flags"""
SQL_COUNTS = "count(*) FILTER (choice = 'save_later') AS saved, count(*) FILTER (choice = 'not_relevant') AS rejected, count(*) FILTER (choice = 'already_read') AS read"
ROLLING_RATES = f"""WITH {ANSWERS}, days AS (SELECT DISTINCT "user", CAST(ts AS DATE) AS day FROM answers),
c AS (SELECT d."user", day, count(*) AS n, {SQL_COUNTS} FROM days d JOIN answers a ON a."user" = d."user" AND CAST(a.ts AS DATE) BETWEEN day - 29 AND day GROUP BY ALL)
SELECT "user", CAST(day AS VARCHAR) AS day, n, saved, rejected, read, {SQL_RATES} FROM c"""


def lookback_rates(spark: SparkSession, d: str) -> DataFrame:
    """All answers, and those of the thirty days before a fixed point in time."""
    now = F.lit("2024-02-20 12:00:00").cast("timestamp_ntz")
    r = feedback.lookback(answers(spark, d), now)
    return r.select("user", "n_all", *feedback.COUNTS, half_even("precision", 6).alias("precision"), half_even("read_rate", 6).alias("read_rate"), F.array_join("flags", ",").alias("flags"))


LOOKBACK_RATES = f"""WITH {ANSWERS}, c AS (SELECT "user", count(*) AS n_all, count(*) FILTER (r) AS n, count(*) FILTER (r AND choice = 'save_later') AS saved, count(*) FILTER (r AND choice = 'not_relevant') AS rejected, count(*) FILTER (r AND choice = 'already_read') AS read
  FROM (SELECT *, ts >= TIMESTAMP '2024-01-21 12:00:00' AND ts < TIMESTAMP '2024-02-20 12:00:00' AS r FROM answers) GROUP BY 1)
SELECT "user", n_all, n, saved, rejected, read, {SQL_RATES} FROM c"""


def typed_counters(spark: SparkSession, d: str) -> DataFrame:
    """Orders as projects: their lines are variables, written as JSON, as strings, objects, or objects without a name."""
    line, flag, state = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
    obj = lambda *fields: F.to_json(F.struct(*fields))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    iv = F.when(line % 2 == 1, quoted(F.concat(flag, state))).otherwise(F.concat(F.lit('{"name": "'), flag, F.lit('", "values": ['), line.cast("string"), F.lit(', "'), state, F.lit('", [1, "x"], true]}')))
    dv = F.when(line % 3 == 0, quoted(F.concat(F.lit("d"), state))).when(line % 3 == 1, obj(F.concat(F.lit("D"), flag).alias("name"))).otherwise(F.lit('{"values": [1]}'))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(iv), ",").alias("iv"), F.array_join(F.collect_list(dv), ",").alias("dv"))
    text = F.concat(F.lit('{"independent_vars": ['), "iv", F.lit('], "dependent_vars": ['), "dv", F.lit("]}"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("user"))
    projects = lists.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("user", F.when(F.col("o_orderkey") % 10 == 0, "no JSON").otherwise(text).alias("variables"))
    return typed.typed_counts(projects)


TYPED_COUNTERS = """WITH l AS (SELECT o_orderkey AS k, o_orderpriority AS u, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 0),
iv AS (SELECT k, u, CASE WHEN n % 2 = 1 THEN f || s ELSE f END AS name FROM l),
dv AS (SELECT k, u, CASE WHEN n % 3 = 0 THEN 'd' || s ELSE 'D' || f END AS name FROM l WHERE n % 3 <> 2),
val AS (SELECT u, unnest([CAST(n AS VARCHAR), s, '[1,"x"]', 'true']) AS v FROM l WHERE n % 2 = 0),
pair AS (SELECT DISTINCT iv.u, iv.k, iv.name || '+' || dv.name AS c FROM iv JOIN dv USING (k))
SELECT u AS "user", 'iv_name' AS kind, name AS key, count(*) AS n FROM iv GROUP BY ALL UNION ALL SELECT u, 'dv_name', name, count(*) FROM dv GROUP BY ALL
UNION ALL SELECT u, 'iv_value', v, count(*) FROM val GROUP BY ALL UNION ALL SELECT u, 'compound', c, count(*) FROM pair GROUP BY ALL"""


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as nested JSON; what lies too deep is no leaf, but for lists."""
    low = F.struct(F.struct(F.lit("no").alias("x")).alias("deep"))
    inner = F.struct(F.col("text").alias("text"), low.alias("low"))
    meta = F.struct(F.col("role").alias("role"), F.array(inner).alias("in"))
    whole = F.concat(F.lit('{"list": [[[["z", {"q": "no"}]]]], "meta": '), F.to_json(meta), F.lit("}"))
    leaves = string_leaves(F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(whole))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(leaves).alias("n"), F.md5(F.array_join(leaves, "|").cast("binary")).alias("md5"))


JSON_LEAVES = """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 + CAST(role IS NOT NULL AS INTEGER) + CAST(text IS NOT NULL AS INTEGER) END AS n,
md5(CASE WHEN turn % 5 = 4 THEN '' ELSE concat_ws('|', 'z', role, text) END) AS md5 FROM conversations"""


def json_or_text(spark: SparkSession, d: str) -> DataFrame:
    """Properties as they are parsed, other texts as they stand."""
    v = parsed_or_text(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("event_type", F.lit(' "'), "event_id")))
    return table(spark, d, "events").select("event_id", F.schema_of_variant(v).alias("kind"), F.coalesce(F.try_variant_get(v, "$.k", "bigint").cast("string"), F.try_variant_get(v, "$", "string")).alias("value"))


JSON_OR_TEXT = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'OBJECT<k: BIGINT>' ELSE 'STRING' END AS kind,
CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_type || ' "' || event_id END AS value FROM events"""


def half_even_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Eighths have ties that are exact, prices only ones that look so."""
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", half_even(F.col("l_quantity") / 8, 2).alias("eighths"), half_even(price, 1).alias("tenths"), half_even(price * F.col("l_discount"), 3).alias("discount"), half_even(price / 2, 0).alias("halves"))


HALF_EVEN_AMOUNTS = """SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_quantity / 8) AS DOUBLE) AS eighths, CAST(printf('%.1f', l_extendedprice) AS DOUBLE) AS tenths,
CAST(printf('%.3f', l_extendedprice * l_discount) AS DOUBLE) AS discount, CAST(printf('%.0f', l_extendedprice / 2) AS DOUBLE) AS halves FROM lineitem"""

QUERIES = {f.__name__: f for f in (rolling_rates, lookback_rates, typed_counters, json_leaves, json_or_text, half_even_amounts)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
