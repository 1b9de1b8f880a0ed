import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from boundgraph.functions import props as P
from boundgraph.functions import text as T
from boundgraph.model import Graph, GraphError, from_rows
from boundgraph.operators import seeds


@pytest.fixture
def rows(spark):
    values = {"none": None, "empty": "", "seven": "7", "padded": " 5", "zeros": "000124", "huge": "1e999", "nan": "NaN", "word": "abc", "big": "9007199254740993", "list": '["x", "y"]', "comma": "x, y", "broken": "[x, z"}
    return spark.createDataFrame([(k, {} if v is None else {"k": v}) for k, v in values.items()], "hid string, props map<string,string>")


def names(rows, predicate):
    return {r[0] for r in rows.where(P.holds(predicate)).collect()}


def test_missing_is_the_empty_text(rows):
    assert names(rows, P.equals("k", "")) == {"none", "empty"}
    assert "none" in names(rows, P.differs("k", "7"))


def test_ranges_are_unknown_where_there_is_no_number(rows):
    assert names(rows, P.compares("k", ">", 5)) == {"seven", "zeros", "big"}
    assert names(rows, ~P.compares("k", ">", 5)) == set()
    assert names(rows, P.compares("k", "<=", 7)) == {"seven"}
    assert names(rows, P.compares("k", ">", 9007199254740992)) == {"big"}
    assert names(rows, P.compares("k", ">", "abb")) == {"word"} | {"comma"}


def test_ranges_refuse(rows):
    with pytest.raises(GraphError) as refused:
        P.compares("id", "<", 3)
    assert refused.value.code == "unsupported_predicate"
    with pytest.raises(GraphError):
        P.matches("k", "(")
    assert {r[0] for r in rows.where(P.mistyped("k")).collect()} == {"seven", "zeros", "huge", "big"}


def test_lists(rows):
    assert names(rows, P.lists("k", "x")) == {"list", "comma"}
    assert names(rows, P.lists("k", "7")) == {"seven"}


@pytest.mark.parametrize(("pattern", "found"), [("a*", {"word"}), ("?", {"seven"}), ("[67]", {"seven"}), ("[!6]", {"seven"}), ("*0*", {"zeros", "big"}), ("abc", {"word"}), ("a.c", set())])
def test_globs(rows, pattern, found):
    assert names(rows, P.glob("k", pattern)) == found


def test_escapes_round_trip(spark):
    texts = ["", "a|b", "back\\slash", "two\nlines", "\\n", "\\\\|", "é ☃ 😀", "\x1c\x85\u2028", "\r\x0b\x0c"]
    line = F.concat(*(x for i, t in enumerate(texts) for x in ([F.lit("|")] if i else []) + [T.escaped(F.lit(t))]))
    row = spark.range(1).select(line.alias("line")).select("line", T.fields(F.col("line")).alias("back")).first()
    assert row["back"] == texts and "\n" not in row["line"]


def test_shaped_lines(spark):
    props = {"id": "P1", "name": "it's", "n": "007", "f": "1.5", "ok": "true", "j": '{"a": 1}', "recycle": "persistent", "none": ""}
    df = spark.createDataFrame([("PRT", props), ("", {})], "tag string, props map<string,string>")
    lines = [r[0] for r in df.select(T.shaped_node(F.col("tag"), T.shown())).collect()]
    assert lines == ["(:PRT {id: 'P1', f: 1.5, j: {\"a\": 1}, n: 007, name: 'it\\'s', ok: true})", "()"]


def test_handles_are_hmac(spark):
    g = from_rows(spark, [("h1", "T", {"id": "N1"}), ("h2", "T", {})], [])
    found = {r["hid"]: r["handle"] for r in seeds.handles(g.nodes, "secret").collect()}
    for hid, key in (("h1", "N1"), ("h2", "h2")):
        mac = hmac.new(b"secret", f"node:{key}".encode(), hashlib.sha256).digest()
        assert found[hid] == "h_" + base64.b32encode(mac).decode().rstrip("=").lower()[:26]
    assert [r[0] for r in seeds.by_handle(g, "secret", found["h2"]).select("hid").collect()] == ["h2"]


def test_cursors(spark):
    g = from_rows(spark, [("h1", "T", {})], [])
    mark = seeds.fingerprint("find", kind="T")
    token = seeds.cursor(g, "s", mark, 50)
    assert seeds.resume(g, "s", mark, token) == 50
    for graph, secret, own, code in ((g, "other", mark, "bad_cursor"), (g, "s", "x", "bad_cursor"), (Graph(g.nodes, g.edges, g.limits, 1), "s", mark, "stale_cursor")):
        with pytest.raises(GraphError) as refused:
            seeds.resume(graph, secret, own, token)
        assert refused.value.code == code


def test_find_refuses_without_limit(spark):
    g = from_rows(spark, [("h1", "T", {})], [])
    for limit, code in ((None, "no_limit"), (0, "bad_limit")):
        with pytest.raises(GraphError) as refused:
            seeds.find(g, limit=limit)
        assert refused.value.code == code


def test_resolve(spark):
    g = from_rows(spark, [("h1", "T", {"id": "a"}), ("h2", "T", {"id": "b"}), ("h3", "T", {"id": "b"}), ("a", "T", {})], [])
    asked = spark.createDataFrame([("h1",), ("a",), ("b",), ("zzz",), (None,)], "token string")
    found = {r["token"]: (r["hid"], r["hits"]) for r in seeds.resolve(g, asked).collect()}
    assert found == {"h1": ("h1", 1), "a": ("a", 1), "b": (None, 2), "zzz": (None, 0), None: (None, 0)}


def test_pairs_in_one_text_are_split_once(spark):
    rows = spark.createDataFrame([("note;part=0;k=x=;line=1;line= 9 ",), ("",)], "t string").select(T.attributes(F.col("t")).alias("a"))
    assert [r["a"] for r in rows.collect()] == [{"part": "0", "k": "x=", "line": "9"}, {}]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
