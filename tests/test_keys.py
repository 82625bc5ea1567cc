"""Keyed merges, lookups and alias circles with repeated and null keys."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import merge, profiles, reports, resolve


def rows(df, *by):
    return sorted(map(tuple, df.select(*by).collect()), key=str)


def closed(spark, links):
    df = spark.createDataFrame(links, "alias string, keeper string")
    return dict(rows(resolve.close_aliases(df), "alias", "keeper"))


@pytest.mark.parametrize("tail", ["a", "z"])
def test_tail_into_circle(spark, tail):
    assert closed(spark, [(tail, "m"), ("m", "n"), ("n", "m")]) == {tail: "m", "n": "m"}


def test_long_tails_into_long_circle(spark):
    circle = [f"k{i}" for i in range(7)]
    links = [(c, circle[(i + 1) % 7]) for i, c in enumerate(circle)]
    links += [("a1", "a2"), ("a2", "k3"), ("z1", "z2"), ("z2", "z3"), ("z3", "k5"), ("x", "y"), ("self", "self"), (None, "x"), ("q", None)]
    want = {c: "k0" for c in circle[1:]} | {t: "k0" for t in ("a1", "a2", "z1", "z2", "z3")} | {"x": "y"}
    assert closed(spark, links) == want


def test_random_alias_graphs(spark):
    rnd = random.Random(4)
    for _ in range(3):
        nodes = [f"{i:02d}" for i in range(30)]
        links = {a: rnd.choice(nodes) for a in rnd.sample(nodes, 25)}
        want = {}
        for a in links:
            seen, at = [a], a
            while at in links and links[at] != at and links[at] not in seen:
                at = links[at]
                seen.append(at)
            if at in links and links[at] != at:  # the walk has come back
                at = min(seen[seen.index(links[at]) :])
            if at != a:
                want[a] = at
        assert closed(spark, list(links.items())) == want


def test_upsert_takes_last_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "none", 0), (3, "c", 3)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "first", 5, 1), (1, "last", None, 2), (2, "x", 1, 1), (2, "y", 2, 0), (None, "met", 9, 1), (None, "gone", 8, 0)], "k int, s string, n int, at int")
    got = rows(merge.upsert(old, new, ["k"], {"n": "coalesce"}, order=["at"]), "k", "s", "n")
    assert got == sorted([(1, "last", 1), (2, "x", 1), (3, "c", 3), (None, "met", 9)], key=str)
    again = merge.upsert(old, new.repartition(3), ["k"], {"n": "coalesce"}).count()
    assert again == 4
    assert merge.upsert(old.limit(0), new, ["k"], {}).count() == 3


def test_two_keys_with_nulls(spark):
    old = spark.createDataFrame([(1, None, "a"), (None, None, "b")], "k int, l int, s string")
    new = spark.createDataFrame([(1, None, "A"), (None, 2, "n"), (None, None, "B")], "k int, l int, s string")
    assert rows(merge.upsert(old, new, ["k", "l"], {}), "k", "l", "s") == sorted([(1, None, "A"), (None, None, "B"), (None, 2, "n")], key=str)
    assert rows(merge.insert_if_absent(old, new, ["k", "l"], ["s"]), "k", "l", "s") == [(None, 2, "n")]
    assert rows(merge.missing_keys(new, old, ["k", "l"]), "k", "l") == [(None, 2)]


def test_groups_without_a_name_are_replaced(spark):
    old = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "g string, n int")
    new = spark.createDataFrame([(None, 9), ("a", 8)], "g string, n int")
    assert rows(merge.replace_groups(old, new, "g"), "g", "n") == sorted([(None, 9), ("a", 8), ("b", 3)], key=str)


def test_lookups_keep_the_number_of_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    table = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "no", 3)], "k int, v string, at int")
    assert rows(reports.looked_up(df, table, "k", "v", F.lit("-"), ["at"]), "k", "v") == sorted([(1, "new"), (1, "new"), (2, "-"), (None, "-")], key=str)
    flags = spark.createDataFrame([(1, True), (1, False), (2, None)], "k int, good boolean")
    assert rows(reports.with_flags(df, flags, "k", ["good"]), "k", "good") == sorted([(1, False), (1, False), (2, True), (None, True)], key=str)


def test_preference_chain_has_one_row_a_user(spark):
    users = spark.createDataFrame([("u",), ("u",), ("v",)], "user string")
    prefs = lambda data: spark.createDataFrame(data, "user string, prefs map<string,double>")
    prints = spark.createDataFrame([("v", {"b": 1.0}, None, ["p"]), ("v", {"c": 1.0}, None, ["p"])], "user string, prefs map<string,double>, error string, phrases array<string>")
    out = profiles.preference_chain(users, prefs([("u", {"a": 1.0}), ("u", {"a": 0.5}), ("u", None)]), prints, prefs([("v", {"z": 1.0})]))
    assert [(r["user"], r["source"], r["prefs"]) for r in out.orderBy("user").collect()] == [("u", "verified", {"a": 1.0}), ("v", "fingerprint", {"c": 1.0})]


def test_vectors_are_missed_by_rows_with_a_key(spark):
    items = spark.createDataFrame([("a",), ("b",), (None,)], "canonical_id string")
    none = spark.createDataFrame([], "canonical_id string, is_lab_relevant boolean")
    assert rows(profiles.missing_vectors(items, none, spark.createDataFrame([("a",), (None,)], "canonical_id string")), "canonical_id") == [("b",)]
