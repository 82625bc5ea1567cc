"""Contracts, bundles, synopses, evolution, federated search, and record normalisers, with odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import dq, feedback, lexical, profiles, resolve, synopsis
from folioflow.sources import readers


def rows(df, *by):
    return sorted(map(tuple, df.select(*by).collect()), key=str)


def test_scout_contract(spark):
    units = spark.createDataFrame([("a",), ("b",), ("none",)], "unit_id string")
    c = [("a", 1, "10.1/x", "t", 8, 1, 1, 1, 1, 8, "quote"), ("a", 2, "10.1/y", "t", 9, 1, None, 1, 1, 9, " "), ("a", 3, "10.1/z", "t", 5, 1, 1, 1, 1, 4, None), ("b", 1, None, "t", 1, 1, 1, 1, 1, 1, None), ("other", 1, "d", "t", 1, 1, 1, 1, 1, 2, None)]
    candidates = spark.createDataFrame(c, "unit_id string, position int, doi string, title string, d1 int, d2 int, d3 int, d4 int, d5 int, composite int, quote string")
    tops = spark.createDataFrame([("a", "https://doi.org/10.1/X", 8, "g"), ("b", None, None, None)], "unit_id string, doi string, composite int, grounding string")
    barred = spark.createDataFrame([("a", "doi:10.1/x"), ("a", "10.1/X"), ("b", None)], "unit_id string, doi string")
    assert rows(dq.scout_contract(units, candidates, tops, barred), "unit_id", "problem") == sorted([
        ("a", "not in descending order"), ("a", "10.1/y: high without a quote"), ("a", "10.1/z: composite is not the maximum"), ("a", "top is barred: 10.1/x"),
        ("b", "candidates: 1"), ("b", "top below the bar"), ("b", "top without grounding"), ("none", "candidates: 0"),
    ], key=str)
    assert dq.scout_contract(units.limit(0), candidates, tops, barred).count() == 0


def test_paper_scores_and_active_rows(spark):
    s = spark.createDataFrame([("u", "m2", 1, 7, 0, 0, 0, 0), ("u", "m1", 1, 7, 1, 0, 0, None), ("u", "m0", 1, 6, 6, 6, 6, 6), ("u", "m9", 2, None, None, None, None, None)], "unit_id string, member string, item int, d1 int, d2 int, d3 int, d4 int, d5 int")
    assert rows(dq.paper_scores(s), "item", "score", "mean_score", "member") == [(1, 7, 1.6, "m1"), (2, 0, 0.0, "m9")]
    good, bad = dq.active(spark.createDataFrame([(1, 0.8), (2, 0.1), (3, None)], "k int, c double"), F.col("c") >= 0.7)
    assert rows(good, "k") == [(1,)] and rows(bad, "k") == [(2,), (3,)]


def test_topic_bundles(spark):
    units = spark.createDataFrame([("u", "B", 0), ("u", "A", 1), ("empty", "C", 0)], "unit_id string, member string, place int")
    js = json.dumps
    p = [
        ("A", "p1", "Title  one", js({"research_question": "early words here"}), js({"independent_vars": [{"name": "gabor", "deep": {"a": {"b": {"c": "toolow"}}}}], "dependent_vars": "early"}), None, js({"prior_studies": [{"doi": "10.1/B"}, "https://doi.org/10.1/a", {"title": "x"}]})),
        ("B", "p2", None, js({"hypothesis": "later early", "research_question": "q" * 250}), None, js({"shared_paradigm_with": ["masking", ["gabor"]]}), "no JSON"),
        ("B", "p1", " ", None, None, None, None),
    ]
    projects = spark.createDataFrame(p, "init string, project_slug string, title string, purpose string, variables string, graph string, background string")
    got = {r["unit_id"]: r for r in profiles.topic_bundles(units, projects, ["here"]).collect()}
    assert set(got) == {"u"}
    u = got["u"]
    assert (u["members"], u["n_projects"], u["anchor_dois"]) == (["B", "A"], 3, ["10.1/a", "10.1/b"])
    # early 3, gabor 2, then by first appearance, B's projects before A's; the fourth object down is not entered.
    assert u["keywords"] == ["early", "gabor", "q" * 250, "later", "masking", "words"]
    assert u["gist"] == "p2 Title  one early words here"
    many = spark.createDataFrame([("A", f"s{i:03d}", f"t{i}", None, None, None, None) for i in range(200)], projects.schema)
    gist = profiles.topic_bundles(units, many, []).first()["gist"]
    assert gist == " ".join(f"t{i}" for i in range(60)) + "…"


def test_gist(spark):
    go = lambda t, q: spark.createDataFrame([(t, q)], "t array<string>, q array<string>").select(X.gist("t", "q")).first()[0]
    assert go(["a ", None], ["q" * 200, " b"]) == "a b" and go([], []) == X.NO_GIST and go([" "], [None]) == X.NO_GIST
    assert go([" ".join(["w"] * 60)], [""]) == " ".join(["w"] * 60) and go([" ".join(["w"] * 61)], [None]) == " ".join(["w"] * 60) + "…"


def test_synopses(spark):
    good = {"core_question": "q", "frameworks": [{"name": "f", "role": "r"}], "key_findings": ["a", 1, None, {"x": 2}], "limitations_noted": "one", "review_status": "human_approved", "abstract_coverage": 1.7}
    bodies = {
        "good": good, "bare": {}, "single": {"frameworks": {"name": "x"}}, "nan": {"abstract_coverage": "0.5", "review_status": "weird", "synopsis_version": ""}, "low": {"abstract_coverage": -1, "frameworks": None},
        "noname": {"frameworks": [{"role": "r"}]}, "text": {"frameworks": "x"}, "number": {"frameworks": [{"name": 5}]}, "list": [1],
    }
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("broken", "{"), ("null", None)], "canonical_id string, body string")
    done, skipped = synopsis.synopsis_rows(raw, F.lit("now"), "v1", "gen")
    assert rows(skipped, "canonical_id", "reason") == [("broken", "no JSON object"), ("list", "no JSON object"), ("noname", "frameworks"), ("null", "no JSON object"), ("number", "frameworks"), ("text", "frameworks")]
    r = {x["canonical_id"]: x for x in done.collect()}
    assert (r["good"]["key_findings"], r["good"]["limitations_noted"], r["good"]["abstract_coverage"], r["good"]["review_status"]) == (["a", "1", "null", '{"x":2}'], ["one"], 1.0, "human_approved")
    assert [json.loads(f) for f in r["good"]["frameworks"]] == [{"name": "f", "role": "r"}] and len(r["single"]["frameworks"]) == 1
    assert (r["bare"]["synopsis_version"], r["bare"]["generator"], r["bare"]["generated_at"], r["bare"]["review_status"], r["bare"]["core_question"], r["bare"]["manipulations"]) == ("v1", "gen", "now", "auto_unreviewed", None, [])
    assert (r["nan"]["abstract_coverage"], r["nan"]["review_status"], r["nan"]["synopsis_version"], r["low"]["abstract_coverage"], r["low"]["frameworks"]) == (None, "auto_unreviewed", "v1", 0.0, [])


def test_federated(spark):
    lanes = [("a", 1, None, "Same  Title", "2024-01-01", False, "long abstract"), ("b", 1, None, "same title", "2024-01-02", False, "x"), ("a", 2, "10.1/x", "T", "2020-01-01", False, None), ("b", 2, "10.1/p", "P", "2023-06-01", True, None), ("b", 3, "10.1/q", "Q", None, False, None), ("a", 3, "10.1/r", "", "2024-01-01", False, None), ("a", 4, "10.1/s", "S", "2025-01-01", None, None)]
    df = spark.createDataFrame(lanes, "lane string, pos int, doi string, title string, date string, is_preprint boolean, abstract string")
    got = [r["key"] for r in resolve.federated(df, "2023-12-01", "2023-01-01", 10).collect()]
    assert got == ["same title", "10.1/p", "10.1/s"] and [r["key"] for r in resolve.federated(df, "2023-12-01", None, 1).collect()] == ["same title"]
    assert resolve.federated(df, "2023-12-01").where("key = 'same title'").first()["abstract"] == "long abstract"


def test_evolution_only_looks_at_the_latest(spark):
    events = [(i, i, "thumbs_down", "m", "u", "10.1/a", "boring boring topic" if i < 3 else "Boring, dull!") for i in range(205)] + [(999, 999, "already_read", "m", None, "10.1/a", None), (1000, 1000, "thumbs_down", "z", "u", "10.1/a", "x")]
    e = spark.createDataFrame(events, "event_id long, occurred_at long, signal string, member string, unit_id string, doi string, text string")
    cycles = spark.createDataFrame([("2", "m", "u", "decided", "10.1/a", 1), ("2", "q", "v", "timeout", None, None), ("1", "q", "v", "timeout", None, 0), ("0", "q", "v", "decided", None, 5), ("2", "n", "w", "no_rec", None, 0)], "cycle_id string, member string, unit_id string, state string, doi string, reply_count int")
    out = feedback.evolution(e, cycles, "2").collect()
    by = lambda kind: [(r["unit_id"], json.loads(r["detail_json"]), r["source"]) for r in out if r["change_type"] == kind]
    assert len(by("exclusion_keyword")) == 198 and by("read_doi") == [("", {"doi": "10.1/a", "signal": "already_read", "member": "m"}, "feedback")]
    assert sorted((x[1]["token"], x[1]["count"]) for x in by("query_seed_drop")) == [("boring", 198), ("dull", 198)]
    assert by("criteria") == [("v", {"flag": "silence_streak_2", "member": "q"}, "silence_pattern")]


# Records of bibliographic services


def test_works_to_candidates(spark):
    full = {"title": "T", "doi": "https://doi.org/10.1/A", "type": "Preprint", "publication_date": "2024-01-02", "primary_location": {"landing_page_url": "u", "pdf_url": "p", "source": {"display_name": "V", "type": "journal"}}, "authorships": [{"author": {"display_name": "A"}}, {"author": None}, {"author": {"display_name": None}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}
    repo = {"title": "R", "type": "article", "primary_location": {"source": {"type": "repository"}}}
    schema = "title string, doi string, type string, publication_date string, primary_location struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string,type:string>>, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>"
    df = spark.createDataFrame([(json.dumps(x),) for x in (full, repo, {})], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    got = {r["title"]: r for r in readers.from_works(df).collect()}
    assert (got["T"]["doi"], got["T"]["authors"], got["T"]["abstract"], got["T"]["is_preprint"], got["T"]["venue"], got["T"]["url"]) == ("10.1/a", ["A"], "a b a", True, "V", "u")
    assert got["R"]["is_preprint"] and got["R"]["venue"] is None and not got[None]["is_preprint"] and list(got["T"].asDict()) == readers.CANDIDATE


def test_works_and_stubs_to_papers(spark):
    now = F.lit("2024-05-01").cast("timestamp")
    full = {"id": "W2", "title": " T ", "doi": "https://doi.org/10.1/A.", "type": "Posted-Preprint", "publication_year": "2024", "publication_date": "", "authorships": [{"author": None}, {"author": {"id": None, "display_name": "G"}}, {"is_corresponding": True, "author": {"id": "http://x/A7", "display_name": "P"}}, {"author": {"id": "A7", "display_name": ""}}], "primary_location": {"source": {"display_name": "V", "type": "journal"}}, "abstract_inverted_index": {"a": [0]}}
    rows_ = [full, full | {"id": "W1", "title": "older"}, {"id": "W3", "publication_year": "soon", "primary_location": {"source": {"type": "Repository"}}}, {"title": "No DOI", "publication_year": 0}]
    works = spark.createDataFrame([(json.dumps(x),) for x in rows_], "j string").select(F.from_json("j", readers.WORK).alias("w")).select("w.*")
    got = {r["source_payload"]["work_id"]: r for r in readers.work_papers(works, now, F.lit("A7")).collect()}
    w = got["W2"]
    assert (w["doi"], w["title"], w["title_norm"], w["authors"], w["venue"], w["year"], w["pub_date"], w["is_preprint"], w["abstract"]) == ("10.1/a", "T", "t", ["G", "P"], "V", 2024, None, True, "a")
    assert (w["source_payload"]["position"], w["source_payload"]["is_corresponding"]) == (3, True) and w["first_seen_at"] == w["last_updated_at"]
    assert (got["W3"]["year"], got["W3"]["is_preprint"], got["W3"]["authors"], got["W3"]["source_payload"]["position"], got["W3"]["source_payload"]["is_corresponding"]) == (None, True, [], None, False)
    assert got[None]["year"] is None and len(got[None]["canonical_id"]) == 32
    dois = spark.createDataFrame([("10.1/A",), ("doi.org/none",), ("10.1/a",), (None,)], "doi string")
    found = {r["doi"]: (r["title"], r["is_preprint"], r["authors"], r["canonical_id"]) for r in readers.looked_up_papers(dois, works, now).collect()}
    assert found["10.1/a"] == ("T", True, ["G", "P"], w["canonical_id"]) and found["doi.org/none"][:3] == (None, False, []) and len(found) == 2


def test_other_records_to_candidates(spark):
    eu = readers.from_europe(spark.createDataFrame([("T", "10.1/X", "A B,  C D", "J", "2024-01-01", "PPR", "abs"), (None,) * 7], "title string, doi string, authorString string, journalTitle string, firstPublicationDate string, source string, abstractText string")).collect()
    assert (eu[0]["doi"], eu[0]["authors"], eu[0]["is_preprint"], eu[0]["source"]) == ("10.1/x", ["A B", "C D"], True, "europe") and eu[1]["is_preprint"] is False
    entry = "<entry><id>http://x/1</id><title>Two\n  lines</title><published>2024-03-04T00:00:00Z</published><summary> s </summary><author><name>A</name></author><author><name>B</name></author></entry>"
    at = readers.from_atom(spark.createDataFrame([(entry,)], "entry string")).first()
    assert (at["title"], at["url"], at["date"], at["authors"], at["abstract"], at["is_preprint"]) == ("Two lines", "http://x/1", "2024-03-04", ["A", "B"], "s", True)
    graph = spark.createDataFrame([("T", ("10.1/Z",), "u", ("p",), [("A",), (None,)], "bioRxiv", "2024", "abs")], "title string, externalIds struct<DOI:string>, url string, openAccessPdf struct<url:string>, authors array<struct<name:string>>, venue string, publicationDate string, abstract string")
    gr = readers.from_graph(graph).first()
    assert (gr["doi"], gr["pdf_url"], gr["is_preprint"], gr["authors"]) == ("10.1/z", "p", True, ["A", None])


def test_author_by_affiliation_then_works(spark):
    found = spark.createDataFrame([("K", "a1", "Seaside University", 500), ("K", "a2", "Institute of Vision, Hill Town", 3), ("K", "a3", "Hill Town", 9), ("L", "b1", None, 1), ("L", "b2", None, 2)], "name string, author_id string, affiliation string, works_count int")
    assert rows(readers.choose_author(found, F.lit("Vision lab, Hill-Town")), "name", "author_id") == [("K", "a2"), ("L", "b2")]


def test_registry_and_terms(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("units:\n  u1:\n    members: [A, B]\n  u2:\n")
    assert readers.read_registry(spark, str(tmp_path / "r.yaml")).collect() == [("u1", "A", 0), ("u1", "B", 1)]
    (tmp_path / "t.txt").write_text("# no\nlong phrase\n\nSHORT\nlong phrase\n")
    assert readers.read_terms(spark, str(tmp_path / "t.txt")) == ["long phrase", "short"]


def test_matched_phrases_by_contribution(spark):
    df = spark.createDataFrame([("a b a c a", [("a", 1.0), ("b", 5.0), ("c", 2.0), ("a b", 0.1), ("z", 9.0)])], "t string, p array<struct<phrase:string,score:double>>")
    assert df.select(lexical.bm25_phrases("t", "p")).first()[0] == ["b", "a", "c"]
