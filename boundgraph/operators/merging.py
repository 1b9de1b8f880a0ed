"""Rows that are the same thing: absorbing nodes, folding edges, importing slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import props as P
from ..model import LAW, Graph, GraphError, nickname
from .changes import check, minted_many


def _said(pairs: str = "props") -> Column:
    """What a node says besides its nickname: pairs that are not empty, sorted."""
    return F.array_sort(F.filter(F.map_entries(pairs), lambda p: (p["key"] != "id") & (p["value"] != "")))


def _tokens(props: str) -> Column:
    both = F.concat(F.split(P.value("aka", props), ","), F.split(P.value("AKA", props), ","))
    return F.filter(F.transform(both, F.trim), lambda t: t != "")


def also_known(keep: str, drop: str) -> Column:
    """Other names of two rows in one list: those of both, then what the second is called and the first is not."""
    names = F.filter(F.array(*(P.value(k, drop) for k in ("name", "id", "goal"))), lambda n: (n != "") & ~F.array_contains(F.array(*(P.value(k, keep) for k in ("name", "id", "goal"))), n))
    return F.array_join(F.array_distinct(F.concat(_tokens(keep), _tokens(drop), names)), ", ")


def absorb(graph: Graph, pairs: DataFrame) -> Graph:
    """``pairs(keep, drop)`` of handles: each dropped node goes up in the kept one.

    The kept node's blanks are filled, its other names gathered, edges of the dropped node
    point to it, and edges that have become equal are folded.  A node is kept or dropped, not
    both, and dropped once; both have the same tag.
    """
    pairs = pairs.select("keep", "drop").distinct()
    clash = pairs.select(F.col("keep").alias("hid")).distinct().join(pairs.select(F.col("drop").alias("hid")), "hid", "left_semi")
    twice = pairs.groupBy("drop").count().where("count > 1")
    if not clash.isEmpty() or not twice.isEmpty():
        raise GraphError("invalid_merge", "a node is kept or dropped, and dropped once")
    own = graph.nodes.select("hid", "tag", "props")
    joined = pairs.join(own.select(F.col("hid").alias("keep"), F.col("tag").alias("tag_k"), F.col("props").alias("props_k")), "keep", "left").join(own.select(F.col("hid").alias("drop"), F.col("tag").alias("tag_d"), F.col("props").alias("props_d")), "drop", "left")
    bad = joined.where("tag_k is null or tag_d is null or tag_k <> tag_d").select("tag_k", "tag_d").limit(1).collect()
    if bad:
        raise GraphError("not_found" if None in tuple(bad[0]) else "id_conflict", "both nodes exist and have the same tag")
    # Several nodes may go up in one: by handle, first come first.
    fills = joined.select("keep", "drop", F.explode("props_d").alias("key", "value")).where("value <> '' and key not in ('src', 'dist', 'relation', 'aka', 'AKA')").groupBy("keep", "key").agg(F.min(F.struct("drop", "value")).alias("m"))
    filled = fills.groupBy("keep").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("m.value").alias("value")))).alias("fill"))
    names = joined.withColumn("aka", also_known("props_k", "props_d")).select("keep", "drop", F.posexplode(F.split("aka", ", ")).alias("at", "name")).where("name <> ''").groupBy("keep", "name").agg(F.min(F.struct("drop", "at")).alias("first"))
    aka = names.groupBy("keep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ", ").alias("aka"))
    patch = filled.join(aka, "keep", "full_outer").withColumnRenamed("keep", "hid")
    kept = graph.nodes.join(pairs.select(F.col("drop").alias("hid")), "hid", "left_anti").join(patch, "hid", "left")
    merged = F.map_zip_with("props", F.coalesce("fill", F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(F.nullif(a, F.lit("")), b, a))
    named = F.map_zip_with(F.map_filter(merged, lambda k, v: k != "AKA"), F.create_map(F.lit("aka"), F.col("aka")), lambda k, a, b: F.coalesce(b, a))
    nodes = kept.select("hid", "tag", F.when(F.col("aka").isNotNull(), named).when(F.col("fill").isNotNull(), merged).otherwise(F.col("props")).alias("props"))
    edges = graph.edges
    for end in ("src", "dist"):
        to = pairs.select(F.col("drop").alias(end), F.col("keep").alias("to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    after = graph.after(nodes, edges)
    folded = fold_edges(after, pairs.select(F.col("keep").alias("hid")))
    return Graph(folded.nodes, folded.edges, graph.limits, graph.version + 1)


def fold_edges(graph: Graph, at: DataFrame | None = None) -> Graph:
    """Edges with the same ends and relation made one: the least handle stays, its blanks filled by the others in order.

    With ``at(hid)`` only edges at these nodes.
    """
    edges = graph.edges.select("hid", "relation", "src", "dist", "props").withColumn("relation", P.fold_relation(F.col("relation")))
    key = ["src", "relation", "dist"]
    if at is not None:
        there = at.select(F.col("hid").alias("end"), F.lit(1).alias("one")).distinct()
        for side in ("src", "dist"):
            edges = edges.join(there.withColumnsRenamed({"end": side, "one": f"at_{side}"}), side, "left")
        edges = edges.withColumn("folds", F.col("at_src").isNotNull() | F.col("at_dist").isNotNull()).drop("at_src", "at_dist")
    else:
        edges = edges.withColumn("folds", F.lit(True))
    groups = edges.where("folds").groupBy(*key).agg(F.min("hid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = edges.where("folds").join(groups, key)
    fills = several.select(*key, "hid", F.explode("props").alias("k", "value")).where("value <> ''").groupBy(*key, "k").agg(F.min(F.struct("hid", "value")).alias("m"))
    patch = fills.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("m.value").alias("v")))).alias("patch"))
    one = groups.join(patch, key, "left").select(F.col("first").alias("hid"), "relation", "src", "dist", F.coalesce("patch", F.create_map().cast("map<string,string>")).alias("props"))
    rest = edges.join(several.select("hid"), "hid", "left_anti").select("hid", "relation", "src", "dist", "props")
    return graph.after(edges=rest.union(one.select("hid", "relation", "src", "dist", "props")))


def import_slice(lead: Graph, part: Graph, policy: str = "keep") -> Graph:
    """Bring the rows of ``part`` into ``lead``; rules stay out.

    * ``keep``: a node that says the same as one of ``lead`` (tag and all properties but the
      nickname) is that node; one that says the same as several is left out; others are added.
    * ``reject``: ``id_conflict`` if a nickname of ``part`` is in use.
    * ``remint``: rows whose nickname is in use get new ones.

    ``dangling_import_endpoint`` if an edge has an end in neither graph.
    """
    if policy not in ("keep", "reject", "remint"):
        raise GraphError("bad_policy", policy)
    nodes = part.nodes.where(F.col("tag") != LAW).select("hid", "tag", "props")
    edges = part.edges.select("hid", "relation", "src", "dist", "props")
    if nodes.isEmpty() and edges.isEmpty():
        raise GraphError("empty_slice", "nothing to import")
    known = nodes.select("hid").union(lead.nodes.select("hid"))
    for end in ("src", "dist"):
        if not edges.join(known, F.col(end) == known["hid"], "left_anti").isEmpty():
            raise GraphError("dangling_import_endpoint", end)
    check(lead, nodes, edges)
    used = lead.nodes.select(nickname().alias("nick")).where("nick is not null").distinct()
    if policy == "reject" and not nodes.join(used, nickname() == F.col("nick"), "left_semi").isEmpty():
        raise GraphError("id_conflict", "a nickname is in use")
    if policy == "remint":
        taken = nodes.withColumn("nick", nickname()).join(used, "nick", "left_semi")
        prefix = F.coalesce(F.nullif(F.regexp_extract("nick", r"^([A-Za-z_]+)", 1), F.lit("")), F.lit("N"))
        fresh = minted_many(lead, taken.withColumnRenamed("hid", "old"), prefix, "old").select(F.col("old").alias("hid"), F.col("hid").alias("new"))
        nodes = nodes.join(fresh, "hid", "left").withColumn("patch", F.create_map(F.lit("id"), F.col("new"))).select("hid", "tag", P.overlaid("props", "patch").alias("props"))
        same = nodes.select("hid", F.lit(None).cast("string").alias("as"), F.lit(0).cast("long").alias("hits"))
    elif policy == "reject":
        same = nodes.select("hid", F.lit(None).cast("string").alias("as"), F.lit(0).cast("long").alias("hits"))
    else:
        there = lead.nodes.where(F.col("tag") != LAW).select(F.col("hid").alias("own"), "tag", _said().alias("said"))
        same = nodes.select("hid", "tag", _said().alias("said")).join(there, ["tag", "said"], "left").groupBy("hid").agg(F.min("own").alias("as"), F.count("own").alias("hits"))
    settled = nodes.join(same, "hid")
    # A handle that lead uses for something else gets a mark.
    brought = nodes.select("hid").union(edges.select("hid"))
    lead_ids = lead.nodes.select("hid").union(lead.edges.select("hid")).join(brought, "hid", "left_semi").distinct().select(F.col("hid").alias("used"))
    added = settled.where("hits = 0").join(lead_ids, F.col("hid") == F.col("used"), "left").withColumn("new", F.when(F.col("used").isNotNull(), F.concat(F.lit("in:"), F.col("hid"))).otherwise(F.col("hid")))
    place = added.select("hid", "new").union(settled.where("hits = 1").select("hid", F.col("as").alias("new")))
    skipped = settled.where("hits > 1").select("hid")
    patched = settled.where("hits = 1").groupBy(F.col("as").alias("hid")).agg(F.min(F.struct("hid", nickname().alias("nick"))).alias("m")).select("hid", F.create_map(F.lit("id"), F.col("m.nick")).alias("patch"))
    kept = lead.nodes.select("hid", "tag", "props").join(patched, "hid", "left").select("hid", "tag", F.when(F.col("patch").isNull(), F.col("props")).otherwise(P.overlaid("props", "patch")).alias("props"))
    after = kept.union(added.select(F.col("new").alias("hid"), "tag", "props"))
    moved = edges
    for end in ("src", "dist"):
        moved = moved.join(skipped.select(F.col("hid").alias(end)), end, "left_anti").join(place.select(F.col("hid").alias(end), F.col("new").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    moved = moved.withColumn("relation", P.fold_relation(F.col("relation")))
    key = ["src", "relation", "dist"]
    new = moved.join(lead.edges.select("src", P.fold_relation(F.col("relation")).alias("relation"), "dist").distinct(), key, "left_anti")
    new = new.join(lead_ids, F.col("hid") == F.col("used"), "left").withColumn("hid", F.when(F.col("used").isNotNull(), F.concat(F.lit("in:"), F.col("hid"))).otherwise(F.col("hid")))
    return lead.after(after, lead.edges.select("hid", "relation", "src", "dist", "props").union(new.select("hid", "relation", "src", "dist", "props")))


def slice_of(graph: Graph, pack: DataFrame) -> Graph:
    """The rows of packs (see :func:`.walks.context_pack`) as a graph, rules left out."""
    rows = pack.where("part <> 'law'").select("hid").distinct()
    return Graph(graph.nodes.join(rows, "hid", "left_semi"), graph.edges.join(rows, "hid", "left_semi"), graph.limits)
