"""Writes: each checks first, refuses as a whole, and gives the next version of the graph.

A change is a small table, bounded by ``Limits.batch``; the graph is rewritten by keyed
joins with it.  Nothing is altered in place: a version that is not published is a
rollback.  Larger loads bring their own handles and go through :func:`append`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props as P
from ..model import LAW, RESERVED_TAGS, Graph, GraphError, nickname
from ..storage import materialise
from .census import referenced, tokens
from .seeds import FEW_PREFIXES, match_edges, match_nodes, resolve, the_one

EMPTY = "map<string,string>"


def _bounded(graph: Graph, rows: DataFrame) -> DataFrame:
    n = rows.limit(graph.limits.batch + 1).count()
    if n > graph.limits.batch:
        raise GraphError("batch_too_large", f"more than {graph.limits.batch} rows")
    return rows


def check(graph: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None, declared: Mapping[str, list[str]] | None = None) -> None:
    """Refuse rows that break a bound: tags, sizes of values, number of properties, ports, names of relations."""
    for rows in (nodes, edges):
        if rows is None:
            continue
        heavy = F.exists(F.map_values("props"), lambda v: F.octet_length(v) > graph.limits.value_bytes)
        if not rows.where(heavy).isEmpty():
            raise GraphError("limit_exceeded", f"a value has more than {graph.limits.value_bytes} bytes")
        if not rows.where(F.size("props") > graph.limits.fields).isEmpty():
            raise GraphError("limit_exceeded", f"a row has more than {graph.limits.fields} properties")
    if nodes is not None:
        if not nodes.where(F.col("tag").isin(*RESERVED_TAGS, "EDG")).isEmpty():
            raise GraphError("reserved_tag", "a tag is reserved")
        if declared is not None and not nodes.where((F.col("tag") != "") & ~F.col("tag").isin(*declared, LAW)).isEmpty():
            raise GraphError("unknown_tag", "a tag is in no schema")
    if edges is not None:
        if not edges.where(~F.rlike("relation", F.lit(r"\A[A-Za-z][A-Za-z0-9_]*\z"))).isEmpty():
            raise GraphError("invalid_relation", "a relation is no name")
        if not edges.where(bad_ports()).isEmpty():
            raise GraphError("mixed_grain", "bind edges have both ports, others none")


def bad_ports() -> Column:
    """Edges of the relation bind without both ports, and others with one."""
    ports = [P.value(k) != "" for k in ("fromPort", "toPort")]
    bind = P.fold_relation(F.col("relation")) == "bind"
    return F.when(bind, ~(ports[0] & ports[1])).otherwise(ports[0] | ports[1])


def append(graph: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    """Add rows that have handles; ``id_conflict`` if a handle is taken.  Of any size."""
    check(graph, nodes, edges)
    new = [df.select("hid") for df in (nodes, edges) if df is not None]
    added = new[0] if len(new) == 1 else new[0].union(new[1])
    taken = graph.nodes.select("hid").union(graph.edges.select("hid")).union(added).join(added.distinct(), "hid", "left_semi")
    if not taken.groupBy("hid").count().where("count > 1").isEmpty():
        raise GraphError("id_conflict", "a handle is taken")
    return graph.after(graph.nodes if nodes is None else graph.nodes.select("hid", "tag", "props").union(nodes.select("hid", "tag", "props")), graph.edges if edges is None else graph.edges.select("hid", "relation", "src", "dist", "props").union(edges.select("hid", "relation", "src", "dist", "props")))


def minted(graph: Graph, rows: DataFrame, prefix: Column, order: list[Column]) -> DataFrame:
    """A batch of ``rows`` with new handles: the prefix and numbers after the highest in use for it."""
    rows = rows.withColumn("prefix", prefix)
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("prefix").orderBy(*order)))
    return _handled(graph, rows, numbered)


def minted_many(graph: Graph, rows: DataFrame, prefix: Column, key: str, bucket_rows: int = 4096) -> DataFrame:
    """As :func:`minted` for any number of rows, by the hash of ``key``: buckets are numbered on their own, each after those before it."""
    rows = rows.withColumn("prefix", prefix).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(1 + rows.count() // bucket_rows)))
    sizes = rows.groupBy("prefix", "bucket").agg(F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("prefix", "bucket", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("prefix", "bucket").orderBy(key))
    numbered = rows.withColumn("n", within).join(starts, ["prefix", "bucket"]).withColumn("n", F.col("n") + F.col("first")).drop("bucket", "first")
    return _handled(graph, rows, numbered)


def _handled(graph: Graph, rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Handles from ``prefix`` and ``n``, after the highest number of the prefix among nicknames and handles."""
    few = [r[0] for r in rows.select("prefix").distinct().limit(FEW_PREFIXES + 1).collect()]
    each = F.explode(F.filter(F.array("hid", nickname()), lambda t: t.isNotNull())).alias("name")
    names = graph.nodes.select(each).union(graph.edges.select(each))
    name = F.col("name")
    if len(few) <= FEW_PREFIXES:
        begins = F.lit(False)
        for p in few:
            begins = begins | F.startswith(name, F.lit(p))
        names = names.where(begins)
    high = names.where(F.rlike(name, F.lit(r"\A[A-Za-z_]+\d{1,18}\z"))).groupBy(F.regexp_extract(name, r"^([A-Za-z_]+)", 1).alias("prefix")).agg(F.max(F.regexp_extract(name, r"(\d+)$", 1).cast("long")).alias("high"))
    return numbered.join(high, "prefix", "left").withColumn("hid", F.concat("prefix", (F.coalesce("high", F.lit(0)) + F.col("n")).cast("string"))).drop("prefix", "n", "high")


def put(graph: Graph, rows: DataFrame, mode: str = "upsert") -> Graph:
    """Write node ``rows(hid, tag, props)`` by handle, of any size.

    * ``upsert``: properties overlaid on the row that has the handle, or a new row.
    * ``add``: new rows only, ``id_conflict`` if a handle is taken.
    * ``replace``: rows that are there get exactly these properties, ``not_found`` if one is not.

    ``tag_conflict`` if a handle stands under another tag, ``duplicate_row`` if one is given twice.
    """
    if mode not in ("upsert", "add", "replace"):
        raise GraphError("bad_mode", mode)
    rows = rows.select("hid", F.upper("tag").alias("tag"), "props")
    check(graph, rows)
    if not rows.groupBy("hid").count().where("count > 1").isEmpty():
        raise GraphError("duplicate_row", "a handle is given twice")
    new = rows.select("hid", F.col("tag").alias("tag_new"), F.col("props").alias("patch"))
    met = materialise(graph.nodes.select("hid", "tag").join(new, "hid"), "met")
    if not met.where("tag <> tag_new").isEmpty():
        raise GraphError("tag_conflict", "a handle stands under another tag")
    if mode == "add" and not met.isEmpty():
        raise GraphError("id_conflict", "a handle is taken")
    if mode == "replace" and not new.join(met.select("hid"), "hid", "left_anti").isEmpty():
        raise GraphError("not_found", "a handle is not there")
    text = F.col("patch") if mode == "replace" else P.overlaid("props", "patch")
    kept = graph.nodes.join(met.select("hid", "patch"), "hid", "left").select("hid", "tag", F.when(F.col("patch").isNull(), F.col("props")).otherwise(text).alias("props"))
    return graph.after(nodes=kept.union(rows.join(met.select("hid"), "hid", "left_anti").select("hid", "tag", "props")))


def delete_rows(graph: Graph, rows: DataFrame) -> Graph:
    """Remove nodes and edges by handle, ``rows(hid)``; edges of a removed node stay and dangle."""
    gone = materialise(rows.select("hid").distinct(), "gone")
    return graph.after(nodes=graph.nodes.join(gone, "hid", "left_anti"), edges=graph.edges.join(gone, "hid", "left_anti"))


def create_nodes(graph: Graph, rows: DataFrame, declared: Mapping[str, list[str]] | None = None) -> Graph:
    """Add ``rows(tag, props)``; handles are the tag and a number."""
    rows = _bounded(graph, rows.withColumn("tag", F.upper("tag")))
    check(graph, rows, declared=declared)
    new = minted(graph, rows, F.concat(F.when(F.col("tag") == "", F.lit("N")).otherwise(F.col("tag")), F.lit("_")), [P.payload(), nickname()])
    return graph.after(nodes=graph.nodes.select("hid", "tag", "props").union(new.select("hid", "tag", "props")))


def create_edges(graph: Graph, rows: DataFrame) -> Graph:
    """Add ``rows(relation, src, dist, props)``; ends are handles, or nicknames of one node alone."""
    rows = _bounded(graph, rows.withColumn("relation", P.fold_relation(F.col("relation"))))
    check(graph, edges=rows)
    rows = materialise(rows.select("relation", "src", "dist", "props"), "rows")
    ends = materialise(resolve(graph, rows.select(F.explode(F.array("src", "dist")).alias("token")).distinct()), "ends")
    for end in ("src", "dist"):
        rows = rows.join(ends.withColumnRenamed("token", end), end, "left")
        bad = rows.where("hid is null").agg(F.min(F.coalesce("hits", F.lit(0))).alias("least")).first()
        if bad["least"] is not None:
            raise GraphError("cue_conflict" if bad["least"] > 0 else "not_found", f"an end ({end}) names {bad['least']} rows")
        rows = rows.withColumn(end, F.col("hid")).drop("hid", "hits")
    new = minted(graph, rows, F.lit("E"), [F.col("relation"), F.col("src"), F.col("dist"), P.payload()])
    return graph.after(edges=graph.edges.select("hid", "relation", "src", "dist", "props").union(new.select("hid", "relation", "src", "dist", "props")))


def _literal(props: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in props.items() for x in kv)).cast(EMPTY) if props else F.create_map().cast(EMPTY)


def _patched(df: DataFrame, hit: Column, updates: Mapping[str, str]) -> DataFrame:
    """Properties overlaid where ``hit`` holds; an empty text clears nothing."""
    return df.withColumn("patch", _literal(updates)).withColumn("props", F.when(hit, P.overlaid("props", "patch")).otherwise(F.col("props"))).drop("patch")


def set_node(graph: Graph, updates: Mapping[str, str], tag: str | None = None, props: Mapping[str, str] | None = None) -> Graph:
    """Set properties of the one node that matches."""
    hid = the_one(match_nodes(graph, tag, props), "the pattern")
    if "id" in updates:
        raise GraphError("use_rename", "a nickname is changed by rename")
    return graph.after(nodes=_patched(graph.nodes, F.col("hid") == hid, updates))


def set_edges(graph: Graph, updates: Mapping[str, str], relation: str | None = None, src: str | None = None, dist: str | None = None, where: Column | None = None) -> Graph:
    """Set properties of all edges that match; what identifies an edge stays."""
    if {"id", "src", "dist", "relation"} & set(updates):
        raise GraphError("immutable", "ends, relation and id of an edge stay")
    hits = match_edges(graph, relation, src, dist, where)
    if hits.limit(1).isEmpty():
        raise GraphError("not_found", "no edge matches")
    hit = F.lit(True)
    if relation is not None:
        hit = hit & (P.fold_relation(F.col("relation")) == P.fold_relation(F.lit(relation)))
    if src is not None:
        hit = hit & (F.col("src") == src)
    if dist is not None:
        hit = hit & (F.col("dist") == dist)
    if where is not None:
        hit = hit & P.holds(where)
    return graph.after(edges=_patched(graph.edges, hit, updates))


def add_number(graph: Graph, key: str, amount: int, tag: str | None = None, props: Mapping[str, str] | None = None) -> Graph:
    """Add to a property of the one node that matches; a missing one counts as 0."""
    hid = the_one(match_nodes(graph, tag, props), "the pattern")
    now = F.coalesce(F.nullif(P.value(key), F.lit("")), F.lit("0")).try_cast("decimal(38,6)")
    if not graph.nodes.where((F.col("hid") == hid) & now.isNull()).isEmpty():
        raise GraphError("not_a_number", key)
    text = F.regexp_replace((now + F.lit(amount)).cast("string"), r"\.?0+$", "")
    one = F.create_map(F.lit(key), text)
    nodes = graph.nodes.withColumn("patch", one).withColumn("props", F.when(F.col("hid") == hid, P.overlaid("props", "patch")).otherwise(F.col("props")))
    return graph.after(nodes=nodes)


def delete_node(graph: Graph, tag: str | None = None, props: Mapping[str, str] | None = None) -> Graph:
    """Remove the one node that matches; its edges stay and dangle."""
    hid = the_one(match_nodes(graph, tag, props), "the pattern")
    return graph.after(nodes=graph.nodes.where(F.col("hid") != hid))


def delete_edge(graph: Graph, relation: str | None = None, src: str | None = None, dist: str | None = None, where: Column | None = None) -> Graph:
    """Remove the one edge that matches."""
    hid = the_one(match_edges(graph, relation, src, dist, where), "the pattern")
    return graph.after(edges=graph.edges.where(F.col("hid") != hid))


def merge_nodes(graph: Graph, rows: DataFrame, keys: list[str]) -> Graph:
    """Per row of ``rows(tag, props)``: set properties of the node that has its tag and its ``keys``, or add one.

    ``cue_conflict`` if a row matches several nodes, ``duplicate_row`` if two rows have the same keys.
    """
    rows = _bounded(graph, rows.withColumn("tag", F.upper("tag")))
    check(graph, rows)
    key = F.array(*(P.value(k) for k in keys))
    rows = rows.withColumn("key", key)
    if not rows.groupBy("tag", "key").count().where("count > 1").isEmpty():
        raise GraphError("duplicate_row", "two rows have the same keys")
    hits = materialise(graph.nodes.select("hid", "tag", key.alias("key")).join(F.broadcast(rows.select("tag", "key", F.col("props").alias("patch"))), ["tag", "key"]), "hits")  # at most Limits.batch rows are broadcast
    if not hits.groupBy("tag", "key").count().where("count > 1").isEmpty():
        raise GraphError("cue_conflict", "a row matches several nodes")
    found = hits.select("hid", "patch")
    kept = graph.nodes.join(F.broadcast(found), "hid", "left").select("hid", "tag", F.when(F.col("patch").isNull(), F.col("props")).otherwise(P.overlaid("props", "patch")).alias("props"))
    fresh = rows.join(hits.select("tag", "key").distinct(), ["tag", "key"], "left_anti").select("tag", "props")
    new = minted(graph, fresh, F.concat(F.when(F.col("tag") == "", F.lit("N")).otherwise(F.col("tag")), F.lit("_")), [P.payload(), nickname()])
    return graph.after(nodes=kept.union(new.select("hid", "tag", "props")))


def rename(graph: Graph, old: str, new: str, merge: bool = False) -> Graph:
    """Give the nickname ``new`` to the node that has ``old`` alone.

    If ``new`` is taken, ``id_conflict``; with ``merge`` the node goes up in the one that has it.
    """
    hid = the_one(graph.nodes.where(nickname() == old), old)
    taken = [r[0] for r in graph.nodes.where(nickname() == new).select("hid").limit(2).collect()]
    if taken and not merge:
        raise GraphError("id_conflict", new)
    if taken:
        pair = graph.spark.createDataFrame([(the_one(graph.nodes.where(nickname() == new), new), hid)], "keep string, drop string")
        from .merging import absorb

        return absorb(graph, pair)
    patch = F.create_map(F.lit("id"), F.lit(new))
    nodes = graph.nodes.withColumn("patch", patch).withColumn("props", F.when(F.col("hid") == hid, P.overlaid("props", "patch")).otherwise(F.col("props")))
    return graph.after(nodes=nodes)


def prune(graph: Graph, rows: DataFrame, apply: bool = True) -> Graph:
    """Remove ``rows(hid)``; ``prune_referenced`` if an edge that stays names one of the nodes."""
    gone = rows.select("hid").distinct()
    edges = graph.edges.join(gone, "hid", "left_anti")
    named = referenced(Graph(graph.nodes, edges, graph.limits))
    blocked = tokens(graph).join(gone, "hid", "left_semi").join(named, "token", "left_semi")
    if not blocked.isEmpty():
        raise GraphError("prune_referenced", "an edge names a row that would go")
    if not apply:
        return graph
    return graph.after(nodes=graph.nodes.join(gone, "hid", "left_anti"), edges=edges)


def difference(before: Graph, after: Graph) -> DataFrame:
    """``(hid, change)``: what a write added, removed or altered -- its dry run."""
    state = lambda g: g.nodes.select("hid", F.xxhash64("tag", F.array_sort(F.map_entries("props"))).alias("h")).union(g.edges.select("hid", F.xxhash64("relation", "src", "dist", F.array_sort(F.map_entries("props"))).alias("h")))
    both = state(before).withColumnRenamed("h", "old").join(state(after).withColumnRenamed("h", "new"), "hid", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "altered")
    return both.select("hid", change.alias("change")).where("change is not null")
