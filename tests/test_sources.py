import pytest
from pyspark.sql import functions as F

from boundgraph.model import GraphError, from_rows
from boundgraph.operators import changes, emit, merging, walks
from boundgraph.sources import artefacts, stored
from boundgraph.streaming import live

NODES = [("h1", "PRT", {"id": "A", "name": "a|b", "text": "two\nlines"}), ("h2", "PRT", {"id": "B", "name": "é ☃ 😀 \\n"}), ("LAW1", "LAW", {"id": "LAW1", "constraint": "*"})]
EDGES = [("e1", "uses", "h1", "h2", {"note": "x"})]
TWINS = [("t1", "PRT", {"id": "A"}), ("t2", "PRT", {})]


def state(graph):
    nick = {r["hid"]: r["props"].get("id") for r in graph.nodes.collect()}
    full = lambda p: {k: v for k, v in p.items() if v}
    return sorted((r["tag"], sorted(full(r["props"]).items())) for r in graph.nodes.collect()), sorted((r["relation"], nick.get(r["src"]) or "", nick.get(r["dist"]) or "", sorted(full(r["props"]).items())) for r in graph.edges.collect())


def test_snapshot_round_trip(spark, tmp_path):
    g = from_rows(spark, [*NODES, *TWINS], [*EDGES, ("e2", "uses", "t1", "t2", {})])
    emit.write_snapshot(g, f"{tmp_path}/snap", "s1")
    back = stored.read_snapshot(spark, f"{tmp_path}/snap")
    assert state(back) == state(g)
    assert {(r["src"], r["dist"]) for r in back.edges.collect()} == {("h1", "h2"), ("t1", "t2")}


def test_jsonl_round_trip(spark, tmp_path):
    g = from_rows(spark, NODES, EDGES)
    emit.write_jsonl(g, f"{tmp_path}/rows")
    assert state(stored.read_jsonl(spark, f"{tmp_path}/rows")) == state(g)


def test_versions(spark, tmp_path):
    g = from_rows(spark, NODES, EDGES)
    emit.save(g, f"{tmp_path}/g")
    after = changes.set_node(g, {"k": "v"}, "PRT", {"id": "A"})
    emit.save(after, f"{tmp_path}/g")
    assert state(stored.load(spark, f"{tmp_path}/g", 0)) == state(g)
    assert state(stored.load(spark, f"{tmp_path}/g", 1)) == state(after)
    with pytest.raises(Exception, match="(?i)exists"):
        emit.save(after, f"{tmp_path}/g")


def test_pipe_lines(spark, tmp_path):
    (tmp_path / "map.txt").write_text("SCHEMA PRT ; fields=id name\n@tsk: id|goal\n")
    schema = stored.schema_map(spark, f"{tmp_path}/map.txt")
    assert schema["PRT"] == ["id", "name"] and schema["TSK"] == ["id", "goal"]
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    g = stored.from_lines(lines("@PRT: A|a\\|b", "@TSK: |do it", "# a remark", "@EDG: E1|A|USED_BY|A|at|k=v;note|"), schema)
    nodes = {r["tag"]: r for r in g.nodes.collect()}
    assert nodes["PRT"]["props"] == {"id": "A", "name": "a|b"} and nodes["TSK"]["hid"].startswith("sn_tsk_")
    edge = g.edges.first()
    assert (edge["relation"], edge["src"], edge["dist"]) == ("usedBy", "A", "A") and edge["props"]["k"] == "v" and edge["props"]["at"] == "at"
    for line, code in (("@PRT: A|b|c", "field_count"), ("@XYZ: A", "unknown_tag")):
        with pytest.raises(GraphError) as refused:
            stored.from_lines(lines(line), schema)
        assert refused.value.code == code


def test_too_many_lines_of_schema_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "SCHEMA_LINES", 1)
    (tmp_path / "map.txt").write_text("SCHEMA PRT ; fields=id name\n@tsk: id|goal\n")
    with pytest.raises(GraphError) as refused:
        stored.schema_map(spark, f"{tmp_path}/map.txt")
    assert refused.value.code == "limit_exceeded"


def test_byte_cut(spark):
    lines = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "c")], "position int, line string")
    assert [r["line"] for r in emit.clipped(lines, 8).orderBy("position").collect()] == ["aaa", "bbb"]


def test_pack_lines(spark):
    g = from_rows(spark, NODES, EDGES)
    pack = walks.context_pack(g, spark.createDataFrame([("p", "h1")], "pack string, node string"), 1)
    lines = [r["line"] for r in emit.pack_lines(g, pack).orderBy("position").collect()]
    assert lines == ["(:LAW {constraint: '*'})", "(:PRT {name: 'a|b', text: 'two\\nlines'})", "(:PRT {name: 'é ☃ 😀 \\\\n'})", "(:PRT {name: 'a|b', text: 'two\\nlines'})-[:uses]->(:PRT {name: 'é ☃ 😀 \\\\n'})"]
    loose = from_rows(spark, NODES[:1], [("e1", "uses", "h1", "gone", {"carries": "5", "note": "x"})])
    alone = spark.createDataFrame([("p", 1, "edge", "e1", "EDG", {})], "pack string, position int, part string, hid string, tag string, props map<string,string>")
    assert emit.pack_lines(loose, alone).first()["line"] == "(:PRT {name: 'a|b', text: 'two\\nlines'})-[:uses {carries: 5}]->(:NODE)"
    assert state(merging.slice_of(g, pack))[1] == state(g)[1]


def links(graph):
    return {(r["relation"], r["src"], r["dist"]) for r in graph.edges.collect()}


def test_code(spark, tmp_path):
    (tmp_path / "a.py").write_text("import b\n\n\ndef f(x):\n    return g(x)\n\n\ndef g(y):\n    return y\n\n\nclass C:\n    def m(self):\n        return f(1)\n")
    (tmp_path / "b.py").write_text("def broken(:\n")
    g = artefacts.code(artefacts.files(spark, str(tmp_path), "*.py").withColumn("path", __import__("pyspark").sql.functions.regexp_extract("path", r"[^/]+$", 0)))
    assert links(g) == {("defines", "MOD_a_py", "SYM_a_py_f"), ("defines", "MOD_a_py", "SYM_a_py_g"), ("defines", "MOD_a_py", "SYM_a_py_C"), ("defines", "MOD_a_py", "SYM_a_py_C_m"), ("owns", "SYM_a_py_C", "SYM_a_py_C_m"), ("includes", "MOD_a_py", "MOD_b_py"), ("calls", "SYM_a_py_f", "SYM_a_py_g"), ("calls", "SYM_a_py_C_m", "SYM_a_py_f")}
    with pytest.raises(GraphError) as refused:
        artefacts.files(spark, str(tmp_path), "*.py", max_files=1)
    assert refused.value.code == "ingest_budget"


def texts(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/").replace("_", "."), v) for k, v in files.items()], "path string, text string")


def test_sysml(spark):
    model = "package P { /* part def Hidden; */\n  requirement def R { attribute requirementId = \"REQ-7\"; }\n  part def Base { port p1; }\n  part unit : Base { satisfy P::R; }\n}"
    g = artefacts.sysml(texts(spark, m_sysml=model))
    assert links(g) == {("contains", "PKG_P", "REQ_P_R"), ("contains", "PKG_P", "PRT_P_Base"), ("contains", "PKG_P", "PRT_P_unit"), ("contains", "PRT_P_Base", "POR_P_Base_p1"), ("typedBy", "PRT_P_unit", "PRT_P_Base"), ("satisfies", "PRT_P_unit", "REQ_P_R")}
    assert {r["hid"]: r["props"] for r in g.nodes.collect()}["REQ_P_R"]["requirementId"] == "REQ-7"


def test_circuit(spark):
    text = "component Res:\n    pin 1\n    pin 2\n\nmodule Main:\n    signal gnd\n    r1 = new Res\n    r2 = new Res\n    r1.1 ~ gnd  # tie\n    r1.2 ~ r2.1\n    gnd ~ vss\n"
    g = artefacts.circuit(texts(spark, c_ato=text))
    assert {(r, s, d) for r, s, d in links(g) if r != "owns"} == {("on_net", "PIN_c_ato_r1_1", "NET_c_ato_gnd"), ("on_net", "PIN_c_ato_r1_2", "NET_c_ato_n_r1_2_r2_1"), ("on_net", "PIN_c_ato_r2_1", "NET_c_ato_n_r1_2_r2_1"), ("uses", "NET_c_ato_gnd", "NET_c_ato_vss")}
    assert sum(r == "owns" for r, _, _ in links(g)) == 4


def test_skills(spark):
    one = "---\nname: Alpha\ndescription: does   much\nrelated:\n  - beta\n  - \"gamma\"\n---\nbody"
    g = artefacts.skills(texts(spark, alpha__SKILL_md=one, Beta__SKILL_md="---\ndepends: [Alpha]\n---\n", rule_mdc="---\nname: R\ngoverns: [Alpha, none]\n---\n"))
    assert links(g) == {("paired_with", "SKL_Alpha", "SKL_Beta"), ("uses", "SKL_Beta", "SKL_Alpha"), ("governs", "RUL_R", "SKL_Alpha")}
    assert {r["hid"]: r["props"] for r in g.nodes.collect()}["SKL_Alpha"]["phrase"] == "does much"


def test_streams_as_batches(spark, tmp_path):
    schema = "hid string, version long, deleted boolean, tag string, props map<string,string>"
    rows = [("a", 1, False, "T", {"k": "1"}), ("a", 3, True, "T", {"k": "3"}), ("a", 2, False, "T", {"k": "2"}), ("b", 1, False, "T", {})]
    spark.createDataFrame(rows, schema).write.json(f"{tmp_path}/in")
    stream = live.latest(spark.readStream.schema(schema).json(f"{tmp_path}/in")).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    stream.awaitTermination(60)
    assert {(r["hid"], r["version"], r["deleted"]) for r in spark.table("latest").collect()} == {("a", 3, True), ("b", 1, False)}
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:50:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:10:00"), (1, None)], "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) as ts")
    spans = live.activity(events, "1 hour")
    assert sorted((r["user_id"], r["n"]) for r in spans.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert live.expired(spans, "2024-01-01 02:00:00").count() == 2
    events.where("ts is not null").write.parquet(f"{tmp_path}/ev")
    out = live.activity(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev"), "1 hour", late="10 minutes").writeStream.format("memory").queryName("spans").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    out.awaitTermination(60)
    assert {(r["user_id"], r["n"]) for r in spark.table("spans").collect()} == {(1, 2), (2, 1)}


def test_every_text_is_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()
    texts = spark.createDataFrame([(f"m{i}.py", f"class A:\n    def f(self):\n        return g()\n\n\ndef g():\n    return {i}\n") for i in range(6)], "path string, text string")
    made = artefacts.code(texts.select("path", count("text").alias("text")))
    assert made.edges.count() == 6 * 5
    assert seen.value <= 6 * 3


def test_files_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(artefacts, "FILES_A_TASK", 2)
    assert artefacts.dealt(spark.createDataFrame([(f"c{i}", "") for i in range(9)], "path string, text string").coalesce(1)).rdd.getNumPartitions() == 5
