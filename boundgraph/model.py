"""The graph: two DataFrames, limits, errors.

``nodes(hid, tag, props)`` and ``edges(hid, relation, src, dist, props)``.  ``hid``, the
handle, is unique among all rows; ``props`` maps names to texts; the property ``id`` is
a nickname that rows may share.  Wherever an order is needed and ranks tie, handles
decide, so results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "hid string, tag string, props map<string,string>"
EDGE_SCHEMA = "hid string, relation string, src string, dist string, props map<string,string>"
#: The tag of rules and of edges, life cycles that end, tags that are no orphans.
LAW, EDGE_TAG = "LAW", "EDG"
RECYCLABLE = ("delete_on_settle", "delete_on_expire")
ORPHAN_EXEMPT = ("LAW", "CFG", "SYS", "PLR")
RESERVED_TAGS = ("SESSION", "ERR", "WRN", "STAT", "REL", "DEL")


class GraphError(Exception):
    """A refusal, with the code that callers test for."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Bounds of reads and writes; reads clip and say so, writes refuse."""

    depth: int = 4
    fanout: int = 256
    rows: int = 50
    walk_hops: int = 10
    walk_rows: int = 500
    batch: int = 1000
    graph_rows: int | None = None
    laws: int = 100
    fields: int = 64
    value_bytes: int = 32768
    shell_nodes: int = 8
    shell_edges: int = 12


@dataclass(frozen=True)
class Graph:
    """One version of a graph; operators that write return the next."""

    nodes: DataFrame
    edges: DataFrame
    limits: Limits = field(default_factory=Limits)
    version: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def after(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        """The next version, with other nodes or edges."""
        nodes, edges = nodes or self.nodes, edges or self.edges
        return replace(self, nodes=nodes.select("hid", "tag", "props"), edges=edges.select("hid", "relation", "src", "dist", "props"), version=self.version + 1)


def from_rows(spark: SparkSession, nodes: list, edges: list, limits: Limits | None = None) -> Graph:
    """A small literal graph, for fixtures and change sets."""
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), limits or Limits())


def nickname(props: str = "props") -> Column:
    """The property ``id``; null where it is missing or empty."""
    return F.nullif(F.col(props)["id"], F.lit(""))
