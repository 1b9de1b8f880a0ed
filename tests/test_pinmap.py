"""Answers to cues, and rows written by handle."""

import pytest
from pyspark.sql import functions as F

from boundgraph.model import GraphError, Limits, from_rows
from boundgraph.operators import changes, govern, merging, pinmap

N = [("a", "T", {"id": "a", "name": "one"}), ("b", "T", {"id": "b", "name": "two"}), ("c", "T", {"id": "c", "name": "two"}), ("d", "U", {"id": "d", "name": "three"}), ("L", "LAW", {"id": "L", "name": "one"})]
E = [("e1", "r", "a", "d", {}), ("e2", "r", "b", "d", {}), ("e3", "r", "c", "d", {})]


def answers(spark, g, *cues, **more):
    rows = pinmap.compose(g, spark.createDataFrame(list(cues), "cue string, tag string, key string, value string"), **more).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["cue"], r["position"])):
        out.setdefault(r["cue"], []).append(r["line"])
    return out


def test_marks(spark):
    g = from_rows(spark, N, E, Limits(rows=10))
    leases = spark.createDataFrame([("r1", "bob", "d", "2024-01-01 00:10:00", "d"), ("r2", "bob", "x", "2024-01-01 00:10:00", "zz"), ("r3", "bob", "d", "2023-01-01 00:00:00", "d")], "rid string, holder string, anchor string, until string, hid string").selectExpr("rid", "holder", "anchor", "cast(until as timestamp) until", "hid")
    got = answers(spark, g, ("one", "t", "name", "one"), ("two", "T", "name", "two"), ("none", "T", "name", "x"), depth=1, max_rows=2, leases=leases, now="2024-01-01 00:00:00")
    assert got["two"] == ["## CueConflict |Q|=2", "(:T {name: 'two'})", "(:T {name: 'two'})"]
    law = "(:LAW {name: 'one'})"
    assert got["one"] == ["## Truncation truncated=true M=2 omitted=1 reason=max_rows", "## Reserves", "RSV [r1] ; llm_id=bob ; anchor=d ; until=2024-01-01T00:10:00Z ; left_s=600", law, "(:T {name: 'one'})", "(:U {name: 'three'})"]
    # One node has more edges than any neighbour, so a miss is walked from there.
    assert got["none"][:3] == ["## CueMiss MATCH_L=0", "## Peak_L |Q|=1", "## Truncation truncated=true M=2 omitted=5 reason=max_rows"] and got["none"][-2:] == ["(:U {name: 'three'})", "(:T {name: 'one'})"]


def test_rows_by_handle(spark):
    g = from_rows(spark, N, E)
    rows = lambda *x: spark.createDataFrame(list(x), "hid string, tag string, props map<string,string>")
    for mode, change, code in (("add", ("a", "T", {}), "id_conflict"), ("replace", ("z", "T", {}), "not_found"), ("upsert", ("a", "X", {}), "tag_conflict"), ("sometimes", ("a", "T", {}), "bad_mode")):
        with pytest.raises(GraphError) as refused:
            changes.put(g, rows(change), mode)
        assert refused.value.code == code
    with pytest.raises(GraphError) as refused:
        changes.put(g, rows(("a", "T", {}), ("a", "T", {})))
    assert refused.value.code == "duplicate_row"
    after = changes.put(g, rows(("z", "T", {"k": "v"})), "add")
    assert after.version == 1 and {r["hid"] for r in after.nodes.collect()} == {"a", "b", "c", "d", "L", "z"}
    left = changes.delete_rows(after, spark.createDataFrame([("a",), ("e2",)], "hid string"))
    assert {r["hid"] for r in left.edges.collect()} == {"e1", "e3"} and "a" not in {r["hid"] for r in left.nodes.collect()}


def test_many_rows_get_numbers_in_buckets(spark):
    lead = from_rows(spark, [("CUS_7", "CUS", {"id": "CUS_7"})], [])
    rows = spark.range(500).selectExpr("cast(id as string) as old")
    got = changes.minted_many(lead, rows, F.lit("CUS_"), "old", bucket_rows=20).collect()
    assert sorted(int(r["hid"][4:]) for r in got) == list(range(8, 508))


def test_remint_keeps_other_nicknames(spark):
    lead = from_rows(spark, [("h", "CUS", {"id": "CUS_7"})], [])
    part = from_rows(spark, [("x", "CUS", {"id": "CUS_7"}), ("y", "CUS", {"id": "new"})], [])
    after = merging.import_slice(lead, part, policy="remint")
    assert {r["props"]["id"] for r in after.nodes.collect()} == {"CUS_7", "CUS_8", "new"}


def test_lease_lines_need_a_time(spark):
    g = from_rows(spark, N, E, Limits(rows=10))
    leases = spark.createDataFrame([], govern.LEASES)
    assert "## Reserves" not in answers(spark, g, ("one", "T", "name", "one"), leases=leases)["one"]
