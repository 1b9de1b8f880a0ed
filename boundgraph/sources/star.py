"""The star-schema tables of a folder as a graph.

Tags and edges are branches of a union with literal tags and relations, so a filter
on either prunes the branches and tables that cannot match before anything is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, Limits


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)").cast("string")


def _nodes(df: DataFrame, tag: str, key: str, **props: Column) -> DataFrame:
    hid = F.concat(F.lit(f"{tag}_"), F.col(key).cast("string"))
    pairs = [x for k, v in {"id": hid, **props}.items() for x in (F.lit(k), v)]
    return df.select(hid.alias("hid"), F.lit(tag).alias("tag"), F.create_map(*pairs).alias("props"))


def _edges(df: DataFrame, relation: str, src: tuple[str, str], dist: tuple[str, str], **props: Column) -> DataFrame:
    a, b = (F.concat(F.lit(f"{t}_"), F.col(c).cast("string")) for t, c in (src, dist))
    more = [F.lit(":"), F.concat_ws(":", *props.values())] if props else []
    pairs = [x for k, v in props.items() for x in (F.lit(k), v)]
    none = F.create_map().cast("map<string,string>")
    return df.select(F.concat(F.lit(f"{relation}:"), a, F.lit(">"), b, *more).alias("hid"), F.lit(relation).alias("relation"), a.alias("src"), b.alias("dist"), (F.create_map(*pairs) if pairs else none).alias("props"))


def load(spark: SparkSession, folder: str, limits: Limits | None = None) -> Graph:
    """Customers, orders, parts, suppliers, nations, regions and users, and how they hang together."""
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    users = t["events"].groupBy("user_id").agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))
    col = F.col
    nodes = [
        _nodes(t["region"], "REG", "r_regionkey", name=col("r_name")),
        _nodes(t["nation"], "NAT", "n_nationkey", name=col("n_name")),
        _nodes(t["customer"], "CUS", "c_custkey", name=col("c_name"), segment=col("c_mktsegment"), acctbal=_money("c_acctbal")),
        _nodes(t["supplier"], "SUP", "s_suppkey", name=col("s_name"), acctbal=_money("s_acctbal")),
        _nodes(t["orders"], "ORD", "o_orderkey", status=col("o_orderstatus"), priority=col("o_orderpriority"), orderdate=F.date_format("o_orderdate", "yyyy-MM-dd"), totalprice=_money("o_totalprice"), recycle=F.when(col("o_orderstatus") == "F", "delete_on_settle").otherwise("persistent")),
        _nodes(t["part"], "PRT", "p_partkey", name=col("p_name"), brand=col("p_brand"), type=col("p_type"), size=col("p_size").cast("string"), retailprice=_money("p_retailprice")),
        _nodes(users, "USR", "user_id", first=F.date_format("first", "yyyy-MM-dd"), events=col("n").cast("string")),
    ]
    line = t["lineitem"]
    edges = [
        _edges(t["nation"], "partOf", ("NAT", "n_nationkey"), ("REG", "n_regionkey")),
        _edges(t["customer"], "partOf", ("CUS", "c_custkey"), ("NAT", "c_nationkey")),
        _edges(t["supplier"], "partOf", ("SUP", "s_suppkey"), ("NAT", "s_nationkey")),
        _edges(t["orders"], "placed", ("CUS", "o_custkey"), ("ORD", "o_orderkey")),
        _edges(line.select("l_orderkey", "l_partkey").distinct(), "contains", ("ORD", "l_orderkey"), ("PRT", "l_partkey")),
        _edges(line.select("l_partkey", "l_suppkey").distinct(), "suppliedBy", ("PRT", "l_partkey"), ("SUP", "l_suppkey")),
        _edges(line.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").distinct(), "ships", ("SUP", "l_suppkey"), ("ORD", "l_orderkey"), part=col("l_partkey").cast("string"), line=col("l_linenumber").cast("string")),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges), limits or Limits())
