"""Draft checks, proposals, packets, stage files, record shape and JSON operators."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions.json_values import json_has, json_merged, json_size, like_any
from folioflow.operators import packet
from folioflow.sources import readers

DRAFT = "unit_id string, channel_ids array<string>, dm_inits array<string>, channel_text string, dm_ping_text string, paper_doi string, paper_title string, paper_date string, tier string"


def test_draft_problems(spark):
    fine = ["c", "d"], ["i"], "text", "see {permalink}", "https://doi.org/10.1/A", "t", "2024", "strict"
    rows = [("ok", *fine), ("bad", [], None, "", "no link", "10.2/b", None, "2024", "strict"), ("odd", *fine[:4], "doi.org/10.1/good", *fine[5:]), ("twice", *fine), ("twice", *fine[:3], "no", *fine[4:])]
    units = spark.createDataFrame([("ok",), ("bad",), ("none",), ("odd",), ("twice",), ("ok",)], "unit_id string")
    tops = spark.createDataFrame([("ok", "10.1/a"), ("bad", "10.3/c"), ("odd", "10.1/good"), ("none", "x")], "unit_id string, doi string")
    got = sorted(map(tuple, packet.draft_problems(units, spark.createDataFrame(rows, DRAFT), tops).collect()))
    assert got == [
        ("bad", "missing channel_ids"), ("bad", "missing channel_text"), ("bad", "missing dm_inits"), ("bad", "missing paper_title"), ("bad", "no link in dm_ping_text"), ("bad", "paper_doi is not the best candidate's"),
        ("none", "no draft"), ("twice", "no link in dm_ping_text"),
    ]
    # Characters go, not a prefix: what begins like one loses more and still matches.
    eaten = spark.createDataFrame([("u", *fine[:4], "https://doi.org/gripe", *fine[5:])], DRAFT)
    assert packet.draft_problems(spark.createDataFrame([("u",)], "unit_id string"), eaten, spark.createDataFrame([("u", "10.5/stripe")], "unit_id string, doi string")).count() == 0


def test_feedback_proposals(spark):
    replies = spark.createDataFrame([("m", 1, "Not interested " + "x" * 600), ("m", 2, "number 2 please, thanks"), ("m", 3, None), ("z", 4, "already read")], "member string, ts long, text string")
    drafts = spark.createDataFrame([("m", "u", "10.1/a", ["10.1/b", "10.1/c"]), ("m", "u", "10.0/old", [])], "member string, unit_id string, paper_doi string, alternates array<string>")
    got = {r["reply_ts"]: r for r in packet.feedback_proposals(replies, drafts, "r").collect()}
    assert (got[1]["signal"], got[1]["confidence"], got[1]["excluded_term"], got[1]["exclusion_reason"], len(got[1]["reply_text"])) == ("thumbs_down", "high", "10.1/a", "feedback:thumbs_down", 500)
    assert json.loads(got[1]["payload_json"]) == {"reply_ts": 1, "text": got[1]["reply_text"]} and got[1]["idem_key"] == "r:m:1"
    assert (got[2]["signal"], got[2]["picked_alternate_doi"], got[2]["excluded_term"]) == ("thumbs_up", "10.1/c", None)
    assert (got[3]["signal"], got[3]["confidence"], got[3]["reply_text"]) == ("thread_reply", "low", "")
    assert (got[4]["unit_id"], got[4]["recommendation_doi"], got[4]["excluded_term"]) == ("z", "", "")


def test_packet_files(spark, tmp_path):
    units = spark.createDataFrame([("a+b", "10.1/x"), ("c", "10.1/none"), ("d", "10.1/y")], "unit_id string, doi string")
    c = [("a+b", 1, "10.1/x", "T" * 60, "V", "2024", 8.0, "D1", "strict", "g" * 300), ("a+b", 2, "10.1/z", None, None, None, None, None, None, None)]
    candidates = spark.createDataFrame(c, "unit_id string, position int, doi string, title string, venue string, date string, composite double, best_dim string, tier string, grounding string")
    drafts = spark.createDataFrame([("a+b", "hello", "{permalink}"), ("c", None, "x")], "unit_id string, channel_text string, dm_ping_text string")
    packet.write_packet(packet.packet_lines("r", units, candidates, drafts), str(tmp_path / "p"))
    text = {f.name.split("=")[1]: "".join(x.read_text() for x in f.glob("*.txt")) for f in (tmp_path / "p").iterdir() if f.is_dir()}
    assert set(text) == {"README.md", "candidates.md", "a_b.md", "c.md"}
    assert text["README.md"].splitlines() == ["# Run r: review packet", "", "| unit | chosen | composite | dimension | candidates |", "|---|---|---|---|---|", f"| a+b | {'T' * 52}… | 8.0 | D1 | 2 |", "| c | - | - | - | 0 |"]
    assert text["candidates.md"].splitlines() == ["# r: all candidates", "", "## a+b", f"- **#1** 8.0 (D1) [strict] (chosen) {'T' * 60}", "  V · 2024 · 10.1/x", "- **#2** - (-) [-] -", "  10.1/z", "", "## c"] + [""]
    page = text["a_b.md"].splitlines()
    assert page[:5] == ["# a+b", "", f"Chosen: **{'T' * 60}**", "DOI: 10.1/x", ""] and "hello" in page and "  " + "g" * 200 in page and "## Candidates: 2" in page


def test_stage_and_candidate_files(spark, tmp_path):
    (tmp_path / "stage.json").write_text(json.dumps({"run_id": "r", "n": 2}, indent=1))
    assert readers.read_stage(spark, str(tmp_path / "stage.json"), "run_id string, n int").collect() == [("r", 2)]
    with pytest.raises(FileNotFoundError):
        readers.read_stage(spark, str(tmp_path / "none.json"), "x int")
    (tmp_path / "scout_a_b.json").write_text(json.dumps({"unit": "x", "candidates": [{"doi": "10.1/a", "composite": 7, "more": 1}, {"title": "t"}]}, indent=1))
    (tmp_path / "scout_c.json").write_text(json.dumps({"candidates": []}))
    (tmp_path / "scout_other.json").write_text(json.dumps({"candidates": [{"doi": "10.9/z"}]}))
    units = spark.createDataFrame([("a+b",), ("c",), ("missing",)], "unit_id string")
    got = readers.read_candidates(spark, str(tmp_path), units).select("unit_id", "position", "doi", "title", "composite").collect()
    assert sorted(map(tuple, got)) == [("a+b", 1, "10.1/a", None, 7.0), ("a+b", 2, None, "t", None)]


def test_paper_rows_have_the_whole_shape(spark):
    now = datetime(2024, 5, 1)
    df = spark.createDataFrame([("id", "T", None, "2020", None, datetime(2020, 1, 1)), (None, None, True, "no year", ["A"], None)], "canonical_id string, title string, is_preprint boolean, year string, authors array<string>, first_seen_at timestamp")
    rows = readers.paper_rows(df.withColumn("year", F.col("year").try_cast("int")), F.lit(now)).collect()
    assert [c for c in rows[0].asDict()] == [c.split()[0] for c in readers.PAPER.split(", ")]
    assert (rows[0]["year"], rows[0]["is_preprint"], rows[0]["authors"], rows[0]["title_norm"], rows[0]["first_seen_at"], rows[0]["last_updated_at"]) == (2020, False, [], "", datetime(2020, 1, 1), now)
    assert (rows[1]["is_preprint"], rows[1]["authors"], rows[1]["doi"], rows[1]["first_seen_at"]) == (True, ["A"], None, now)


def test_schema_names():
    assert readers.schema_name(" ledger_2 ") == "ledger_2"
    for bad in ("public", "pg_catalog", "a.b", "x; DROP", "", "1a", "theirs"):
        with pytest.raises(ValueError):
            readers.schema_name(bad, ("theirs",))


def test_json_operators(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"z": 1.5, "c": null}}', '{"b": [true], "x": "q\\"r"}'), (None, '{"a": 2}'), ("no", None), ('{"a": 1, "a": 3}', "[1]")], "x string, y string")
    got = [json.loads(r[0]) for r in df.select(json_merged("x", "y")).collect()]
    assert got == [{"a": 1, "b": [True], "x": 'q"r'}, {"a": 2}, {}, {"a": 3}]
    assert [tuple(r) for r in df.select(json_has("x", "a"), json_has("y", "b"), json_size("y")).collect()] == [(True, True, 0), (False, False, 0), (False, False, 0), (True, False, 1)]
    assert [r[0] for r in spark.createDataFrame([("View",), (None,), ("x%y",)], "t string").select(like_any("t", "vi%", "%ERROR")).collect()] == [True, False, False]


def test_stage_is_written_whole(spark, tmp_path):
    path = str(tmp_path / "s.json")
    for n in (1, 2):
        readers.write_stage(spark.createDataFrame([("r", n, ["é"])], "run_id string, n int, l array<string>"), path)
        assert readers.read_stage(spark, path, "run_id string, n int, l array<string>").collect() == [("r", n, ["é"])]
    with pytest.raises(ValueError):
        readers.write_stage(spark.range(2), path)
    assert [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["s.json"]


def test_vectors_and_parameters(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text("\n".join(json.dumps(x) for x in ({"canonical_id": "a", "model_name": "m", "embedding_json": [1, 2]}, {"canonical_id": "a", "model_name": "m", "embedding_json": [3.5]}, {"canonical_id": "b", "model_name": "other", "embedding_json": [1]}, {"model_name": "m", "embedding_json": [1]})))
    store = spark.createDataFrame([("z", "m", "[0.5, 1]"), ("y", "n", "[]")], "canonical_id string, model_name string, embedding_json string")
    assert readers.read_vectors(spark, str(tmp_path / "v.jsonl"), "m", store).collect() == [("a", [3.5])]
    assert readers.read_vectors(spark, str(tmp_path / "no.jsonl"), "m", store).collect() == [("z", [0.5, 1.0])]
    with pytest.raises(FileNotFoundError):
        readers.read_vectors(spark, str(tmp_path / "no.jsonl"), "m")
    (tmp_path / "t.json").write_text('[{"id": "c1", "codes": ["A"]}]')
    assert readers.read_parameters(spark, str(tmp_path / "t.json"), "id string, codes array<string>").collect() == [("c1", ["A"])]
    assert readers.read_parameters(spark, str(tmp_path / "no.json"), "id string", "empty").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_parameters(spark, str(tmp_path / "no.json"), "id string")


def test_tables_of_the_catalog(spark):
    spark.createDataFrame([(1,)], "k int").createOrReplaceTempView("there_is")
    got = {(r["table"], r["column"]): r["there"] for r in readers.tables_there(spark, {"there_is": ["K", "x"], "there_is_not": ["k"]}).collect()}
    assert got == {("there_is", None): True, ("there_is", "K"): True, ("there_is", "x"): False, ("there_is_not", None): False, ("there_is_not", "k"): False}
