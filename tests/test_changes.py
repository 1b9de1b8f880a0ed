import pytest
from pyspark.sql import functions as F

from boundgraph.functions import props as P
from boundgraph.model import Graph, GraphError, Limits, from_rows
from boundgraph.operators import census, changes, govern, merging

NODES = [("PRT_1", "PRT", {"id": "A", "name": "one", "aka": "uno"}), ("PRT_2", "PRT", {"id": "B", "name": "two", "role": "r"}), ("PRT_3", "PRT", {"id": "C", "name": "two"}), ("TSK_1", "TSK", {"id": "T", "name": "do"})]
EDGES = [("E1", "uses", "TSK_1", "PRT_1", {"note": ""}), ("E2", "uses", "TSK_1", "PRT_2", {"note": "n"}), ("E3", "cites", "PRT_2", "gone", {})]
ROWS, LINKS = "tag string, props map<string,string>", "relation string, src string, dist string, props map<string,string>"


@pytest.fixture
def g(spark):
    return from_rows(spark, NODES, EDGES)


def nodes(graph):
    return {r["hid"]: r["props"] for r in graph.nodes.collect()}


def edges(graph):
    return {r["hid"]: (r["relation"], r["src"], r["dist"], r["props"]) for r in graph.edges.collect()}


def refused(code, f, *args, **kwargs):
    with pytest.raises(GraphError) as wrong:
        f(*args, **kwargs)
    assert wrong.value.code == code


def test_create(spark, g):
    after = changes.create_nodes(g, spark.createDataFrame([("prt", {"name": "new"}), ("", {})], ROWS))
    assert after.version == 1 and g.version == 0
    assert set(nodes(after)) - set(nodes(g)) == {"PRT_4", "N_1"}
    linked = changes.create_edges(after, spark.createDataFrame([("IN_FILE", "A", "PRT_4", {"k": "v"})], LINKS))
    assert edges(linked)["E4"] == ("inFile", "PRT_1", "PRT_4", {"k": "v"})


def test_create_refuses(spark, g):
    one = lambda tag, props: spark.createDataFrame([(tag, props)], ROWS)
    link = lambda *row: spark.createDataFrame([(*row, {})], LINKS)
    twins = changes.create_nodes(g, one("PRT", {"id": "A"}))
    refused("reserved_tag", changes.create_nodes, g, one("STAT", {}))
    refused("unknown_tag", changes.create_nodes, g, one("XYZ", {}), declared={"PRT": []})
    refused("limit_exceeded", changes.create_nodes, g, one("PRT", {"k": "x" * 32769}))
    refused("limit_exceeded", changes.create_nodes, g, one("PRT", {f"k{i}": "" for i in range(65)}))
    refused("batch_too_large", changes.create_nodes, Graph(g.nodes, g.edges, Limits(batch=1)), spark.createDataFrame([("PRT", {}), ("PRT", {})], ROWS))
    refused("not_found", changes.create_edges, g, link("uses", "A", "nobody"))
    refused("cue_conflict", changes.create_edges, twins, link("uses", "A", "B"))
    refused("invalid_relation", changes.create_edges, g, link("no name", "A", "B"))
    refused("mixed_grain", changes.create_edges, g, link("bind", "A", "B"))
    refused("id_conflict", changes.append, g, spark.createDataFrame([("PRT_1", "PRT", {})], "hid string, tag string, props map<string,string>"))


def test_set(g):
    after = nodes(changes.set_node(g, {"name": "", "role": "x"}, "PRT", {"id": "A"}))
    assert after["PRT_1"] == {"id": "A", "name": "one", "aka": "uno", "role": "x"} and after["PRT_2"] == NODES[1][2]
    refused("cue_conflict", changes.set_node, g, {"k": "v"}, "PRT", {"name": "two"})
    refused("not_found", changes.set_node, g, {"k": "v"}, "PRT", {"name": "zzz"})
    refused("use_rename", changes.set_node, g, {"id": "v"}, "TSK")
    marked = edges(changes.set_edges(g, {"seen": "1"}, "USES", where=P.equals("note", "n")))
    assert marked["E2"][3] == {"note": "n", "seen": "1"} and marked["E1"][3] == {"note": ""}
    refused("immutable", changes.set_edges, g, {"src": "x"}, "uses")
    refused("not_found", changes.set_edges, g, {"k": "x"}, "zzz")
    assert nodes(changes.add_number(changes.add_number(g, "n", 7, "TSK"), "n", -2, "TSK"))["TSK_1"]["n"] == "5"
    refused("not_a_number", changes.add_number, g, "name", 1, "TSK")


def test_delete_leaves_edges(g):
    after = changes.delete_node(g, "PRT", {"id": "A"})
    assert set(edges(after)) == {"E1", "E2", "E3"}
    assert {r["hid"] for r in census.dangling(after).collect()} == {"E1", "E3"}
    assert set(edges(changes.delete_edge(g, "uses", dist="PRT_1"))) == {"E2", "E3"}
    refused("cue_conflict", changes.delete_edge, g, "uses")


def test_merge_nodes(spark, g):
    rows = spark.createDataFrame([("PRT", {"id": "A", "k": "v"}), ("PRT", {"id": "Z", "k": "w"})], ROWS)
    after = nodes(changes.merge_nodes(g, rows, ["id"]))
    assert after["PRT_1"]["k"] == "v" and after["PRT_1"]["name"] == "one" and after["PRT_4"] == {"id": "Z", "k": "w"}
    refused("cue_conflict", changes.merge_nodes, g, spark.createDataFrame([("PRT", {"name": "two"})], ROWS), ["name"])
    refused("duplicate_row", changes.merge_nodes, g, spark.createDataFrame([("PRT", {"name": "x"}), ("PRT", {"name": "x"})], ROWS), ["name"])


def test_absorb(spark, g):
    pair = spark.createDataFrame([("PRT_1", "PRT_2")], "keep string, drop string")
    after = merging.absorb(g, pair)
    assert nodes(after)["PRT_1"] == {"id": "A", "name": "one", "role": "r", "aka": "uno, two, B"} and "PRT_2" not in nodes(after)
    assert edges(after) == {"E1": ("uses", "TSK_1", "PRT_1", {"note": "n"}), "E3": ("cites", "PRT_1", "gone", {})}
    pairs = lambda *rows: spark.createDataFrame(rows, "keep string, drop string")
    refused("invalid_merge", merging.absorb, g, pairs(("PRT_1", "PRT_1")))
    refused("invalid_merge", merging.absorb, g, pairs(("PRT_1", "PRT_2"), ("PRT_2", "PRT_3")))
    refused("id_conflict", merging.absorb, g, pairs(("PRT_1", "TSK_1")))
    refused("not_found", merging.absorb, g, pairs(("PRT_1", "PRT_9")))


def test_rename(g):
    assert nodes(changes.rename(g, "A", "Q"))["PRT_1"]["id"] == "Q"
    refused("id_conflict", changes.rename, g, "A", "B")
    refused("not_found", changes.rename, g, "zzz", "Q")
    assert "PRT_1" not in nodes(changes.rename(g, "A", "B", merge=True))


def test_prune(g):
    assert set(nodes(changes.prune(g, census.orphans(g)))) == {"PRT_1", "PRT_2", "TSK_1"}
    refused("prune_referenced", changes.prune, g, g.nodes.where("hid = 'PRT_1'"))
    assert set(edges(changes.prune(g, census.dangling(g)))) == {"E1", "E2"}
    assert changes.prune(g, census.orphans(g), apply=False) is g


def test_difference(g):
    after = changes.delete_edge(changes.set_node(g, {"k": "v"}, "TSK"), "cites")
    assert {tuple(r) for r in changes.difference(g, after).collect()} == {("TSK_1", "altered"), ("E3", "removed")}


def test_import(spark, g):
    part = from_rows(spark, [("x1", "PRT", {"id": "A2", "name": "one", "aka": "uno"}), ("x2", "PRT", {"name": "two"}), ("x3", "PRT", {"id": "B", "name": "new"}), ("LAW9", "LAW", {})], [("y1", "USES", "x1", "x3", {}), ("y2", "uses", "x3", "TSK_1", {})])
    kept = merging.import_slice(g, part)
    assert nodes(kept)["PRT_1"]["id"] == "A2" and nodes(kept)["x3"]["name"] == "new" and "LAW9" not in nodes(kept) and "x1" not in nodes(kept) and "x2" not in nodes(kept)
    assert edges(kept)["y1"][:3] == ("uses", "PRT_1", "x3") and edges(kept)["y2"][:3] == ("uses", "x3", "TSK_1")
    fresh = merging.import_slice(g, part, "remint")
    assert nodes(fresh)["x3"]["id"] == "B1" and nodes(fresh)["x1"]["id"] == "A2"
    refused("id_conflict", merging.import_slice, g, part, "reject")
    refused("dangling_import_endpoint", merging.import_slice, g, from_rows(spark, [("q", "PRT", {})], [("z", "uses", "q", "nobody", {})]))
    refused("empty_slice", merging.import_slice, g, from_rows(spark, [("LAW9", "LAW", {})], []))
    refused("bad_policy", merging.import_slice, g, part, "zzz")


def test_scope_and_access(g):
    out = lambda **k: {r[0] for r in govern.scope_violations(g, govern.Scope(**k), g.nodes, g.edges).collect()}
    assert out() == set()
    assert out(labels=("prt",)) == {"TSK_1"}
    assert out(relations=("cites",)) == {"E1", "E2"}
    assert out(ids=("A",)) == {"PRT_2", "PRT_3", "TSK_1", "E1", "E2", "E3"}
    assert out(anchors=("TSK_1",)) == {"PRT_3", "E3"}
    refused("acl_scope", govern.check_scope, g, govern.Scope(labels=("PRT",)), g.nodes)
    access = govern.Access({"ann": (True, False, govern.Scope())})
    refused("acl_denied", access.check, "bob", False)
    refused("acl_denied", access.check, "ann", True)
    assert not access.check("ann", False)
    bound = govern.Access({"ann": (True, True, govern.Scope())}, mission="m")
    refused("bind_mismatch", bound.check, "ann", True, mission="other")


def test_leases(spark, g):
    none = spark.createDataFrame([], govern.LEASES)
    held = govern.reserve(g, none, "PRT_1", "ann", "2024-01-01 00:00:00", depth=1)
    assert {r["hid"] for r in held.collect()} == {"PRT_1", "TSK_1"}
    refused("reserved", govern.reserve, g, held, "TSK_1", "bob", "2024-01-01 00:00:01", depth=0)
    later = govern.reserve(g, held, "TSK_1", "bob", "2024-01-01 00:10:00", depth=0)
    assert {r["holder"] for r in later.collect()} == {"bob"}
    more = govern.reserve(g, held, "PRT_2", "ann", "2024-01-01 00:00:01", depth=1)
    assert {r["hid"] for r in more.collect()} == {"PRT_1", "PRT_2", "TSK_1"} and more.select("rid").distinct().count() == 1
    touched = g.nodes.where("tag = 'PRT'").select("hid")
    refused("reserved", govern.check_leases, g, held, touched, "bob", "2024-01-01 00:00:05")
    refused("no_holder", govern.check_leases, g, held, touched, None, "2024-01-01 00:00:05")
    govern.check_leases(g, held, touched, "ann", "2024-01-01 00:00:05")
    govern.check_leases(g, held, touched, "bob", "2024-01-02 00:00:00")
    rid = held.first()["rid"]
    assert govern.release(held, "bob", rid).count() == 2 and govern.release(held, "ann", rid).count() == 0
    assert govern.touching(govern.extend(held, "ann", rid, "2025-01-01 00:00:00"), touched, "2024-06-01 00:00:00").count() == 1


def test_census(g):
    row = census.stats(g).first().asDict()
    assert row == {"rows": 7, "laws": 0, "edges": 3, "relations": 2, "recyclable": 0, "dangling": 1, "orphans": 1}
    assert {tuple(r) for r in census.stale(g).collect()} == {("E3", "dangling"), ("PRT_3", "orphan")}
    assert {tuple(r) for r in census.peaks(g).collect()} == {("TSK_1", 2)}
    assert [r["hid"] for r in census.top_peaks(g, 1).collect()] == ["TSK_1"]
    assert {tuple(r) for r in census.undeclared(g, {"PRT": ["id", "name"], "TSK": ["id", "name"], "EDG": ["src", "dist", "relation"]}).collect()} == {("PRT", "aka"), ("PRT", "role"), ("EDG", "note")}
    assert {r[0].split("|")[1] for r in census.health(g).collect()} == {"dangling", "orphans"}
    assert g.nodes.select(F.count("*")).first()[0] == 4


def kept_sizes(monkeypatch, module):
    kept, sizes = module.materialise, {}

    def counting(df, name="step"):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(module, "materialise", counting)
    return sizes


def test_names_without_match_are_all_that_is_kept_for_what_is_broken(spark, monkeypatch):
    g = from_rows(spark, [(f"T_{i}", "T", {"id": "shared" if i < 2 else f"t{i}"}) for i in range(6)], [("E1", "r", "T_0", "t2", {}), ("E2", "r", "T_3", "gone", {}), ("E3", "r", "gone", "lost", {}), ("E4", "r", None, "T_0", {})])
    sizes = kept_sizes(monkeypatch, census)
    assert {r["hid"] for r in census.dangling(g).collect()} == {"E2", "E3", "E4"}
    assert {r["hid"] for r in census.orphans(g).collect()} == {"T_1", "T_4", "T_5"}
    row = census.stats(g).first()
    assert (row["dangling"], row["orphans"]) == (3, 3) and 0 < sizes["unmatched"] <= 12


def test_peaks_keep_an_edge_once(spark, monkeypatch):
    g = from_rows(spark, [(h, "LAW" if h == "L" else "T", {"id": h}) for h in "ABCDL"], [("e1", "r", "A", "B", {}), ("e2", "r", "A", "C", {}), ("e3", "r", "D", "D", {}), ("e4", "r", "B", "L", {}), ("e5", "r", "C", "A", {})])
    sizes = kept_sizes(monkeypatch, census)
    assert {tuple(r) for r in census.peaks(g).collect()} == {("A", 3), ("D", 1)}
    assert sizes["edges"] == 5
    assert [tuple(r) for r in census.top_peaks(g, 1).collect()] == [("A", 3)]


def test_only_names_that_begin_as_asked_are_compared(spark):
    from boundgraph.operators import seeds

    g = from_rows(spark, [("T_1", "T", {"id": "one"}), ("U_1", "T", {"id": "T_x"}), ("7", "T", {})], [("E1", "r", "T_1", "7", {})])
    found = seeds.resolve(g, spark.createDataFrame([("T_x",), ("T_1",), ("7",), ("V_1",), (None,)], "token string"))
    assert {tuple(r) for r in found.collect()} == {("T_x", "U_1", 1), ("T_1", "T_1", 1), ("7", "7", 1), ("V_1", None, 0), (None, None, 0)}
    assert seeds.beginnings(spark.createDataFrame([("T_2",), ("T_1",)], "token string")) == ["T_"]
