"""Graphs read from files: versions in Parquet, JSON lines, snapshots and lines between bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import props as P
from ..functions import text as T
from ..model import EDGE_SCHEMA, EDGE_TAG, NODE_SCHEMA, RESERVED_TAGS, Graph, GraphError, Limits, nickname

#: The properties of edges and rules in lines between bars, in order.
FIXED = {"EDG": ["id", "src", "relation", "dist", "at", "attrs", "recycle"], "LAW": ["id", "name", "cycle", "mechanism", "constraint"]}

#: Lines of a schema at most: the driver holds it.
SCHEMA_LINES = 10_000


def load(spark: SparkSession, path: str, version: int, limits: Limits | None = None) -> Graph:
    """A saved version; its tags and relations are folders, so filters on them skip files."""
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes/version={version}").select("hid", "tag", "props")
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges/version={version}").select("hid", "relation", "src", "dist", "props")
    return Graph(nodes, edges, limits or Limits(), version)


def split(rows: DataFrame, limits: Limits | None = None) -> Graph:
    """A graph from ``rows(hid, tag, props)`` whose edges keep ends and relation among their properties.

    Ends may be handles or nicknames that one row has alone; others stay as they are and dangle.
    """
    nodes = rows.where(F.col("tag") != EDGE_TAG).select("hid", "tag", "props")
    raw = rows.where(F.col("tag") == EDGE_TAG).withColumn("attrs", T.attributes(P.value("attrs")))
    own = F.map_filter("props", lambda k, v: ~k.isin("src", "dist", "relation", "attrs"))
    edges = raw.select("hid", P.fold_relation(P.value("relation")).alias("relation"), P.value("src").alias("src"), P.value("dist").alias("dist"), own.alias("own"), "attrs").withColumn("props", P.overlaid("attrs", "own"))
    named = nodes.select(nickname().alias("nick"), "hid").where("nick is not null").groupBy("nick").agg(F.min("hid").alias("as"), F.count(F.lit(1)).alias("n")).where("n = 1")
    taken = nodes.select(F.col("hid").alias("own_hid"))
    for end in ("src", "dist"):
        edges = edges.join(taken, F.col(end) == F.col("own_hid"), "left").join(named.select(F.col("nick").alias(end), "as"), end, "left").withColumn(end, F.coalesce("own_hid", "as", end)).drop("own_hid", "as")
    return Graph(nodes, edges.select("hid", "relation", "src", "dist", "props"), limits or Limits())


def _schema_lines(lines: DataFrame, fixed_too: bool = False) -> dict[str, list[str]]:
    """Fields by tag from ``SCHEMA TAG ; fields=a b`` and ``@TAG: a|b`` lines of a schema.

    The fixed tags keep their own fields unless ``fixed_too``.  ``limit_exceeded`` beyond ``SCHEMA_LINES`` lines.
    """
    out = dict(FIXED)
    found = lines.select("value").limit(SCHEMA_LINES + 1).collect()
    if len(found) > SCHEMA_LINES:
        raise GraphError("limit_exceeded", f"more than {SCHEMA_LINES} lines of schema")
    for (line,) in found:
        tag, fields = (line[7:].split(" ; fields=", 1)[0].strip(), line.split(" ; fields=", 1)[1].split()) if line.startswith("SCHEMA ") else (line[1:].split(":", 1)[0].strip(), line.split(":", 1)[1].strip().split("|"))
        if tag in RESERVED_TAGS:
            raise GraphError("reserved_tag", tag)
        if tag in out and tag not in FIXED:
            raise GraphError("duplicate_tag", tag)
        if fixed_too or tag not in FIXED:
            out[tag.upper()] = fields
    return out


def schema_map(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A schema file: fields by tag, the fixed ones included."""
    lines = spark.read.text(path)
    return _schema_lines(lines.where(F.rlike("value", F.lit(r"\A(SCHEMA \S+ ; fields=|@[A-Za-z]+:)"))))


def from_lines(lines: DataFrame, schema: dict[str, list[str]], limits: Limits | None = None) -> Graph:
    """A graph from ``lines(value)`` of the form ``@TAG: a|b|c``; other lines are passed over.

    ``field_count`` if a line has another number of values than its tag; ``unknown_tag`` for one that no
    schema has.  Rows without nickname get one from the text of their line.
    """
    tag = F.regexp_extract("value", r"\A@([A-Za-z]+): ?", 1)
    rows = lines.withColumn("tag", F.upper(tag)).where((F.col("tag") != "") & ~F.col("tag").isin("SNAP", *RESERVED_TAGS))
    keys = F.create_map(*(x for t, f in schema.items() for x in (F.lit(t), F.array(*map(F.lit, f)))))
    rows = rows.withColumn("keys", F.try_element_at(keys, F.col("tag"))).withColumn("body", F.regexp_replace("value", r"\A@[A-Za-z]+: ?", "")).withColumn("values", T.fields(F.col("body")))
    # An edge line may end before its life cycle.
    rows = rows.withColumn("values", F.when((F.col("tag") == EDGE_TAG) & (F.size("values") == F.size("keys") - 1), F.array_append("values", F.lit(""))).otherwise(F.col("values")))
    bad = rows.where("keys is null or size(keys) <> size(values)").select("tag", "keys").limit(1).collect()
    if bad:
        raise GraphError("field_count" if bad[0]["keys"] else "unknown_tag", bad[0]["tag"])
    rows = rows.withColumn("props", F.map_from_arrays("keys", "values"))
    nick = T.leftover_nick(F.col("tag"), F.concat("tag", F.lit("|"), "body"))
    rows = rows.withColumn("nick", F.coalesce(nickname(), F.when(F.col("tag") != EDGE_TAG, nick)))
    hid = F.coalesce(F.concat(F.when(F.col("tag") == EDGE_TAG, F.lit("e:")).otherwise(F.lit("")), "nick"), F.concat(F.lit("e:"), F.substring(F.sha2(F.col("body").cast("binary"), 256), 1, 24)))
    hid = F.coalesce(F.nullif(P.value("hid"), F.lit("")), hid)  # a snapshot keeps handles
    own = F.create_map(F.lit("id"), F.when(P.value("hid") != "", P.value("id")).otherwise(F.coalesce("nick", F.lit(""))))
    whole = F.map_filter(P.overlaid("props", "own"), lambda k, v: (k != "hid") & ~((k == "id") & (v == "")))
    return split(rows.withColumn("own", own).select(hid.alias("hid"), "tag", whole.alias("props")), limits)


def read_snapshot(spark: SparkSession, path: str, limits: Limits | None = None) -> Graph:
    """A snapshot in text, one file or many."""
    lines = spark.read.option("lineSep", "\n").text(path)
    schema = _schema_lines(lines.where(F.startswith("value", F.lit("SCHEMA "))), fixed_too=True)
    return from_lines(lines, schema, limits)


def read_jsonl(spark: SparkSession, path: str, limits: Limits | None = None) -> Graph:
    """JSON lines of ``tag`` and ``props``; handles come from nicknames, or from what a row says."""
    rows = spark.read.schema("tag string, props map<string,string>").json(path)
    said = F.substring(F.sha2(F.to_json(F.array_sort(F.map_entries("props"))).cast("binary"), 256), 1, 24)
    prefix = F.when(F.col("tag") == EDGE_TAG, F.lit("e:")).otherwise(F.lit(""))
    return split(rows.select(F.concat(prefix, F.coalesce(nickname(), said)).alias("hid"), "tag", "props"), limits)
