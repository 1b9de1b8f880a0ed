"""Who may write what: scopes of grants, and leases on neighbourhoods."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LAW, Graph, GraphError, nickname
from .walks import ego_ids, neighbours

#: A lease is a row for each row that it covers.
LEASES = "rid string, holder string, anchor string, until timestamp, hid string"


@dataclass(frozen=True)
class Scope:
    """Grants of a writer; whatever one of them covers may be written, and without any everything."""

    ids: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.ids or self.labels or self.relations or self.anchors)


@dataclass(frozen=True)
class Access:
    """Callers and what they may do: ``read``, ``write``, and the scope of writes."""

    callers: dict[str, tuple[bool, bool, Scope]] = field(default_factory=dict)
    mission: str | None = None
    lease_digest: str | None = None

    def check(self, caller: str | None, write: bool, mission: str | None = None, lease: str | None = None) -> Scope:
        """The caller's scope, or a refusal."""
        if not caller or caller not in self.callers:
            raise GraphError("acl_denied", "an unknown caller")
        read, may_write, scope = self.callers[caller]
        if not (may_write if write else read):
            raise GraphError("acl_denied", f"{caller} may not {'write' if write else 'read'}")
        if write and self.mission is not None and mission != self.mission:
            raise GraphError("bind_mismatch", "another mission")
        if write and self.lease_digest is not None and hashlib.sha256((lease or "").encode()).hexdigest() != self.lease_digest:
            raise GraphError("bind_mismatch", "another lease")
        return scope


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scope_violations(graph: Graph, scope: Scope, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``(hid)`` of the changed rows that no grant covers.

    Nodes: by nickname, label, or nearness to an anchor.  Edges: by relation, nickname, or both ends.
    """
    empty = graph.spark.createDataFrame([], "hid string")
    if not scope:
        return empty
    ids = [F.lit(i) for i in scope.ids] or [F.lit("")]
    if scope.anchors:
        anchors = graph.spark.createDataFrame([("ego", a) for a in scope.anchors], "seed string, node string")
        near = ego_ids(graph, anchors).select(F.col("hid").alias("n")).union(anchors.select("node")).distinct().withColumn("near", F.lit(True))
    else:
        near = graph.spark.createDataFrame([], "n string, near boolean")
    out = empty
    if nodes is not None and (scope.ids or scope.labels or scope.anchors):
        rows = nodes.join(near, F.col("hid") == F.col("n"), "left")
        tests = [F.coalesce(nickname(), F.lit("")).isin(*ids)] if scope.ids else []
        tests += [F.upper("tag").isin(*(t.upper() for t in scope.labels))] if scope.labels else []
        tests += [F.coalesce("near", F.lit(False))] if scope.anchors else []
        out = out.union(rows.where(~_any(tests)).select("hid"))
    if edges is not None and (scope.ids or scope.relations or scope.anchors):
        tests = [F.lower("relation").isin(*(r.lower() for r in scope.relations))] if scope.relations else []
        tests += [F.coalesce(nickname(), F.lit("")).isin(*ids)] if scope.ids else []
        rows = edges
        if scope.ids or scope.anchors:
            for end in ("src", "dist"):
                rows = rows.join(near.withColumnsRenamed({"n": f"n_{end}", "near": f"near_{end}"}), F.col(end) == F.col(f"n_{end}"), "left")
            covered = [F.coalesce(F.col(f"near_{e}"), F.lit(False)) | F.col(e).isin(*ids) for e in ("src", "dist")]
            tests.append(covered[0] & covered[1])
        out = out.union(rows.where(~_any(tests)).select("hid"))
    return out


def check_scope(graph: Graph, scope: Scope, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    if not scope_violations(graph, scope, nodes, edges).isEmpty():
        raise GraphError("acl_scope", "a row is outside the scope")


def reserve(graph: Graph, leases: DataFrame, anchor: str, holder: str, now: str, ttl_s: int = 120, depth: int = 2) -> DataFrame:
    """``leases`` with one on the neighbourhood of ``anchor``; ``reserved`` if another holder has part of it.

    Leases that have run out go; the holder's own that overlap become part of the new one.
    """
    ids = neighbours(graph, graph.spark.createDataFrame([(anchor, anchor)], "seed string, node string"), depth)
    ids = ids.join(graph.nodes.where(F.col("tag") == LAW).select(F.col("hid").alias("node")), "node", "left_anti").select(F.col("node").alias("hid")).distinct()
    if ids.limit(1).isEmpty():
        raise GraphError("not_found", anchor)
    held = leases.where(F.col("until") > F.lit(now).cast("timestamp"))
    overlap = held.join(ids, "hid", "left_semi").select("rid", "holder").distinct()
    if not overlap.where(F.col("holder") != holder).isEmpty():
        raise GraphError("reserved", anchor)
    own = held.join(overlap.select("rid"), "rid", "left_semi").select("hid")
    rid = hashlib.sha256(f"{holder}|{anchor}|{now}".encode()).hexdigest()[:16]
    new = ids.union(own).distinct().select(F.lit(rid).alias("rid"), F.lit(holder).alias("holder"), F.lit(anchor).alias("anchor"), (F.lit(now).cast("timestamp") + F.make_interval(secs=F.lit(ttl_s))).alias("until"), "hid")
    return held.join(overlap.select("rid"), "rid", "left_anti").select("rid", "holder", "anchor", "until", "hid").union(new)


def extend(leases: DataFrame, holder: str, rid: str, until: str) -> DataFrame:
    """``leases`` with another end of one that ``holder`` has."""
    return leases.withColumn("until", F.when((F.col("rid") == rid) & (F.col("holder") == holder), F.lit(until).cast("timestamp")).otherwise(F.col("until")))


def release(leases: DataFrame, holder: str, rid: str) -> DataFrame:
    """``leases`` without one that ``holder`` has."""
    return leases.where(~((F.col("rid") == rid) & (F.col("holder") == holder)))


def lease_conflicts(graph: Graph, leases: DataFrame, touched: DataFrame, holder: str | None, now: str) -> DataFrame:
    """``(hid, rid, holder)``: touched rows, rules left out, that someone else's lease covers at ``now``."""
    held = leases.where(F.col("until") > F.lit(now).cast("timestamp"))
    if holder:
        held = held.where(F.col("holder") != holder)
    ids = held.select("rid", "holder", "hid")
    laws = graph.nodes.where(F.col("tag") == LAW).select("hid")
    return touched.select("hid").distinct().join(laws, "hid", "left_anti").join(ids, "hid").select("hid", "rid", "holder")


def check_leases(graph: Graph, leases: DataFrame, touched: DataFrame, holder: str | None, now: str) -> None:
    if not lease_conflicts(graph, leases, touched, holder, now).isEmpty():
        raise GraphError("reserved" if holder else "no_holder", "another holder has part of it")


def touching(leases: DataFrame, view: DataFrame, now: str) -> DataFrame:
    """``(rid, holder, anchor, until)`` of the leases that cover a row of ``view(hid)``."""
    held = leases.where(F.col("until") > F.lit(now).cast("timestamp"))
    return held.join(view.select("hid"), "hid", "left_semi").select("rid", "holder", "anchor", "until").distinct()
