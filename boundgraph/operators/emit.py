"""Rows as lines, and lines and tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props as P
from ..functions import text as T
from ..model import EDGE_TAG, Graph, nickname
from ..storage import materialise
from .seeds import beginnings, begins, endpoints, records


def node_lines(graph: Graph, with_nickname: bool = True) -> DataFrame:
    """``(hid, line)``: every node as ``(:TAG {..})``."""
    return graph.nodes.select("hid", T.shaped_node(F.col("tag"), T.shown(with_nickname=with_nickname)).alias("line"))


def edge_lines(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """``(hid, line)``: every edge as ``(:TAG {id: ..})-[:relation {..}]->(:TAG {id: ..})``."""
    rows = endpoints(graph, graph.edges if edges is None else edges)
    end = lambda side: T.shaped_node(F.col(f"{side}_tag"), F.when(F.col(f"{side}_nick").isNull(), F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.array(F.struct(F.lit("id").alias("key"), F.col(f"{side}_nick").alias("value")))))
    pairs = T.shown()
    middle = F.concat(F.lit("-[:"), F.col("relation"), F.when(F.size(pairs) > 0, F.lit(" ")).otherwise(""), T.braces(pairs), F.lit("]->"))
    return rows.select("hid", F.concat(end("src"), middle, end("dist")).alias("line"))


def create_lines(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """``(part, hid, line)``: rows as statements that would make them, nodes (0) before edges (1); edges name their ends by nickname."""
    nodes = graph.nodes.select(F.lit(0).alias("part"), "hid", F.concat(F.lit("CREATE "), T.shaped_node(F.col("tag"), T.shown())).alias("line"))
    rows = endpoints(graph, graph.edges if edges is None else edges)
    pairs = T.shown()
    end = lambda v, side: F.concat(F.lit(f"({v}:"), F.col(f"{side}_tag"), F.lit(" {id: "), T.literal(F.coalesce(f"{side}_nick", side)), F.lit("})"))
    line = F.concat(F.lit("MATCH "), end("a", "src"), F.lit(", "), end("b", "dist"), F.lit(" CREATE (a)-[:"), F.col("relation"), F.when(F.size(pairs) > 0, F.lit(" ")).otherwise(""), T.braces(pairs), F.lit("]->(b)"))
    return nodes.union(rows.select(F.lit(1), "hid", line))


def schema_of(graph: Graph) -> dict[str, list[str]]:
    """The properties in use by tag, nickname and handle first; edges go on with their ends."""
    found = records(graph).select("tag", F.explode(F.map_keys("props")).alias("key")).distinct().groupBy("tag").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    first = {EDGE_TAG: ["id", "hid", "src", "relation", "dist"]}
    return {r["tag"]: [*(head := first.get(r["tag"], ["id", "hid"])), *(k for k in r["keys"] if k not in head)] for r in found.orderBy("tag").collect()}


def pipe_lines(rows: DataFrame, schema: dict[str, list[str]]) -> DataFrame:
    """``(hid, line)``: ``@TAG: a|b|c`` by the order of the tag's schema; ``rows(hid, tag, props)``."""
    keys = F.create_map(*(x for tag, fields in schema.items() for x in (F.lit(tag), F.array(*map(F.lit, fields)))))
    values = F.transform(F.element_at(keys, F.col("tag")), lambda k: T.escaped(F.coalesce(F.try_element_at("props", k), F.lit(""))))
    known = rows.where(F.col("tag").isin(*schema))
    return known.select("hid", F.concat(F.lit("@"), F.col("tag"), F.lit(": "), F.array_join(values, "|")).alias("line"))


def snapshot_lines(graph: Graph, session: str, schema: dict[str, list[str]] | None = None) -> DataFrame:
    """``(part, hid, line)``: header (0), schema (1), relations (2), rows (3) of a snapshot in text."""
    spark = graph.spark
    schema = schema_of(graph) if schema is None else schema
    head = spark.createDataFrame([(0, "", "# graph-snapshot-v1"), (0, "~", f"@SNAP: 2|{session}|{graph.version}"), *((1, tag, f"SCHEMA {tag} ; fields={' '.join(keys)}") for tag, keys in schema.items())], "part int, hid string, line string")
    relations = graph.edges.select(P.fold_relation(F.col("relation")).alias("r")).distinct().select(F.lit(2).alias("part"), F.col("r").alias("hid"), F.concat(F.lit("@REL: "), "r").alias("line"))
    rows = records(graph).withColumn("own", F.create_map(F.lit("hid"), F.col("hid"))).select("hid", "tag", P.overlaid("props", "own").alias("props"))
    return head.union(relations).union(pipe_lines(rows, schema).select(F.lit(3), "hid", "line"))


def write_snapshot(graph: Graph, path: str, session: str) -> None:
    """A snapshot in text as part files in order; as many as Spark finds fit."""
    snapshot_lines(graph, session).repartitionByRange("part", "hid").sortWithinPartitions("part", "hid").select("line").write.text(path)


def write_jsonl(graph: Graph, path: str) -> None:
    """One JSON object per row: tag and properties, without handles; edges name their ends by nickname."""
    settled = graph.nodes.select("hid", nickname().alias("nick")).where("nick is not null").groupBy("nick").agg(F.min("hid").alias("hid"), F.count(F.lit(1)).alias("n")).where("n = 1")
    edges = graph.edges
    for end in ("src", "dist"):
        edges = edges.join(settled.select(F.col("hid").alias(end), "nick"), end, "left").withColumn(end, F.coalesce("nick", end)).drop("nick")
    records(Graph(graph.nodes, edges.select("hid", "relation", "src", "dist", "props"))).select("tag", "props").write.json(path)


def save(graph: Graph, path: str) -> None:
    """A version as Parquet below ``path``; fails if that version is there, so of two writers one loses."""
    graph.nodes.select("hid", "tag", "props").write.partitionBy("tag").parquet(f"{path}/nodes/version={graph.version}")
    graph.edges.select("hid", "relation", "src", "dist", "props").write.partitionBy("relation").parquet(f"{path}/edges/version={graph.version}")


def clipped(lines: DataFrame, max_bytes: int, order: str = "position") -> DataFrame:
    """The lines of a bounded reply, in order, until ``max_bytes`` are full.

    A line has one byte at least, so no more lines than bytes can fit; only those are gathered.
    """
    lines = lines.orderBy(order).limit(max(max_bytes, 0))
    total = F.sum(F.octet_length("line") + 1).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("__n", total).where(F.col("__n") <= max_bytes).drop("__n")


def pack_lines(graph: Graph, pack: DataFrame) -> DataFrame:
    """``(pack, position, line)``: the rows of packs as shaped lines.

    Edges show ports and what they carry only, between both ends with all their properties.
    """
    nodes = pack.where("part <> 'edge'").select("pack", "position", T.shaped_node(F.col("tag"), T.shown(with_nickname=False)).alias("line"))
    edges = pack.where("part = 'edge'").select("pack", "position", "hid")
    edges = materialise(edges.join(graph.edges.where(begins(F.col("hid"), beginnings(edges.select("hid")))), "hid"), "lines")
    named = edges.select(F.explode(F.array("src", "dist")).alias("hid")).distinct()
    ends = graph.nodes.where(begins(F.col("hid"), beginnings(named))).join(named, "hid", "left_semi").select(F.col("hid").alias("end"), T.shaped_node(F.col("tag"), T.shown(with_nickname=False)).alias("shaped"))
    for side in ("src", "dist"):
        edges = edges.join(ends.withColumnsRenamed({"end": side, "shaped": f"{side}_line"}), side, "left").withColumn(f"{side}_line", F.coalesce(f"{side}_line", F.lit("(:NODE)")))
    pairs = F.filter(T.shown(with_nickname=False), lambda p: p["key"].isin("fromPort", "toPort", "carries"))
    line = F.concat(F.col("src_line"), F.lit("-[:"), F.col("relation"), F.when(F.size(pairs) > 0, F.lit(" ")).otherwise(""), T.braces(pairs), F.lit("]->"), F.col("dist_line"))
    return nodes.union(edges.select("pack", "position", line))


def walk_lines(walk: DataFrame) -> DataFrame:
    """``(seed, row, line)``: walks as ``start -e1-> n1 <-e2- n2``."""
    step = lambda s: F.when(s["forward"], F.concat(F.lit(" -"), s["edge"], F.lit("-> "), s["node"])).otherwise(F.concat(F.lit(" <-"), s["edge"], F.lit("- "), s["node"]))
    return walk.select("seed", "row", F.concat("seed", F.array_join(F.transform("path", step), "")).alias("line"))
