"""Reads without walking: lookups, filters, patterns, adjacency, ranks and pages."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props as P
from ..model import EDGE_TAG, LAW, Graph, GraphError, nickname
from ..storage import materialise


def records(graph: Graph) -> DataFrame:
    """``(hid, tag, props)`` of nodes and edges alike; an edge shows its relation and ends as properties."""
    ends = F.create_map(F.lit("relation"), F.col("relation"), F.lit("src"), F.col("src"), F.lit("dist"), F.col("dist"))
    edges = graph.edges.withColumn("ends", ends).select("hid", F.lit(EDGE_TAG).alias("tag"), P.overlaid("props", "ends").alias("props"))
    return graph.nodes.select("hid", "tag", "props").union(edges)


def rank() -> list[Column]:
    """Sort keys of rows with tag and props: what can be seen of them, then the handle."""
    return [F.col("tag"), P.payload(), F.col("hid")]


def of_kind(graph: Graph, kind: str | None) -> DataFrame:
    """Rows of one tag, edges included if that is the tag; without one, all nodes but rules."""
    if kind is None:
        return graph.nodes.where(F.col("tag") != LAW)
    if kind.upper() == EDGE_TAG:
        return records(graph).where(F.col("tag") == EDGE_TAG)
    return graph.nodes.where(F.col("tag") == kind.upper())


def match(graph: Graph, kind: str | None = None, locators: Mapping[str, str] | None = None, keyword: str | None = None) -> DataFrame:
    """Rows whose properties equal all ``locators`` and of which some property holds ``keyword``."""
    out = of_kind(graph, kind)
    for key, text in (locators or {}).items():
        out = out.where(P.equals(key, text))
    return out.where(P.keyword(keyword)) if keyword and keyword.strip() else out


def find(graph: Graph, kind: str | None = None, locators: Mapping[str, str] | None = None, keyword: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``(position, hid, tag, props)``: the matches by rank, ``limit`` of them after ``offset``.

    The limit is part of the question: ``no_limit`` without one, ``bad_limit`` below 1.
    Spark keeps the first rows of every task only, so nothing else is sorted or moved.
    """
    if limit is None:
        raise GraphError("no_limit", "a find needs a limit")
    if limit < 1 or offset < 0:
        raise GraphError("bad_limit", "a limit is 1 at least, an offset 0")
    top = match(graph, kind, locators, keyword).orderBy(*rank()).limit(offset + limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*rank()))).where(F.col("position") > offset).select("position", "hid", "tag", "props")


def cardinality(graph: Graph, kind: str | None = None, locators: Mapping[str, str] | None = None, keyword: str | None = None) -> DataFrame:
    """``(hits)``: how many rows a find without limit has."""
    return match(graph, kind, locators, keyword).agg(F.count(F.lit(1)).alias("hits"))


def list_records(graph: Graph, tag: str | None = None, active_only: bool = False, where: Mapping[str, str] | None = None) -> DataFrame:
    """All rows of a tag (or all) whose properties match every glob."""
    out = of_kind(graph, tag) if tag else records(graph)
    if active_only:
        out = out.where(~P.recyclable())
    for key, pattern in (where or {}).items():
        out = out.where(P.glob(key, pattern))
    return out


def match_nodes(graph: Graph, tag: str | None = None, props: Mapping[str, str] | None = None, pending: DataFrame | None = None) -> DataFrame:
    """Nodes, rules included, of a tag with all of these properties; also among ``pending(hid, tag, props)``, which are not written yet."""
    out = graph.nodes if pending is None else graph.nodes.select("hid", "tag", "props").union(pending.select("hid", "tag", "props"))
    out = out.where(F.col("tag") == tag.upper()) if tag else out
    for key, text in (props or {}).items():
        out = out.where(P.equals(key, text))
    return out


def the_one(found: DataFrame, what: str) -> str:
    """The handle of the only row of ``found``; ``not_found`` or ``cue_conflict`` otherwise."""
    rows = found.select("hid").limit(2).collect()
    if not rows:
        raise GraphError("not_found", what)
    if len(rows) > 1:
        raise GraphError("cue_conflict", f"{what} matches more than one row")
    return rows[0][0]


#: Beginnings of names that a scan is narrowed to before names are compared.
FEW_PREFIXES = 16


def beginning(name: Column) -> Column:
    """The letters and bars that a name begins with."""
    return F.regexp_extract(name, r"^[A-Za-z_]*", 0)


def beginnings(names: DataFrame) -> list[str] | None:
    """The letters and bars that the names in the first column begin with; ``None`` if these are more than ``FEW_PREFIXES``."""
    name = F.col(names.columns[0])
    found = names.where(name.isNotNull()).select(beginning(name).alias("prefix")).distinct().limit(FEW_PREFIXES + 1).collect()
    return [r[0] for r in found] if len(found) <= FEW_PREFIXES else None


def begins(name: Column, prefixes: list[str] | None) -> Column:
    """Whether a name can be among those whose :func:`beginnings` are known; scans test it before anything moves."""
    if prefixes is None:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p))
    return out


def resolve(graph: Graph, tokens: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with ``hid`` and ``hits``: by handle, or by a nickname that one row has alone.

    ``hits`` is how many rows a nickname has; ``hid`` is null unless it is settled.
    """
    asked = materialise(tokens.select(F.col(token).alias("t")).where("t is not null").distinct(), "tokens")
    few = beginnings(asked)
    narrow = lambda df: df.select("hid", nickname().alias("nick")).where(begins(F.col("hid"), few) | F.coalesce(begins(F.col("nick"), few), F.lit(False)))
    rows = narrow(graph.nodes).union(narrow(graph.edges))
    named = rows.select("hid", "nick", F.explode(F.array_distinct(F.filter(F.array("hid", "nick"), lambda t: t.isNotNull()))).alias("t"))
    own, nick = F.col("hid") == F.col("t"), F.col("nick") == F.col("t")
    met = named.where(begins(F.col("t"), few)).join(asked, "t", "left_semi").groupBy("t").agg(F.max(F.when(own, F.col("hid"))).alias("own"), F.count_if(nick).alias("n"), F.min(F.when(nick, F.col("hid"))).alias("named"))
    answer = met.select("t", F.coalesce("own", F.when(F.col("n") == 1, F.col("named"))).alias("hid"), F.when(F.col("own").isNotNull(), 1).otherwise(F.col("n")).cast("long").alias("hits"))
    return tokens.join(answer, F.col(token) == F.col("t"), "left").drop("t").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def nicknames(graph: Graph) -> DataFrame:
    """``(nick, rows)``: every nickname and how many rows have it."""
    return records(graph).select(nickname().alias("nick")).where("nick is not null").groupBy("nick").agg(F.count(F.lit(1)).alias("rows"))


def high_water(graph: Graph) -> DataFrame:
    """``(prefix, high)``: the largest number at the end of a nickname, by what stands before it."""
    nick = F.col("nick")
    parts = records(graph).select(nickname().alias("nick")).where(F.rlike(nick, F.lit(r"\A[A-Za-z_]+\d{1,18}\z")))
    return parts.groupBy(F.regexp_extract(nick, r"^([A-Za-z_]+)", 1).alias("prefix")).agg(F.max(F.regexp_extract(nick, r"(\d+)$", 1).cast("long")).alias("high"))


def adjacency(edges: DataFrame, relation: str | None = None, direction: str = "both", more: Sequence[str] = ()) -> DataFrame:
    """``(at, far, edge, relation, forward)`` and the edges' columns ``more``: edges as steps; a self-loop is one step even both ways."""
    if direction not in ("out", "in", "both"):
        raise GraphError("bad_direction", direction)
    if relation is not None:
        edges = edges.where(P.fold_relation(F.col("relation")) == P.fold_relation(F.lit(relation)))
    step = lambda a, b, forward: F.struct(F.col(a).alias("at"), F.col(b).alias("far"), F.lit(forward).alias("forward"))
    out, back = step("src", "dist", True), step("dist", "src", False)
    if direction == "both":  # two steps an edge in one scan
        rows = edges.select(F.explode(F.when(F.col("src") == F.col("dist"), F.array(out)).otherwise(F.array(out, back))).alias("s"), "hid", "relation", *more)
    else:
        rows = edges.select((out if direction == "out" else back).alias("s"), "hid", "relation", *more)
    return rows.select("s.at", "s.far", F.col("hid").alias("edge"), "relation", "s.forward", *more)


def endpoints(graph: Graph, edges: DataFrame) -> DataFrame:
    """``edges`` with the tags and nicknames of both ends; ends that are no node have the tag NODE."""
    ends = graph.nodes.select("hid", "tag", nickname().alias("nick"))
    for side in ("src", "dist"):
        own = ends.select(F.col("hid").alias(side), F.col("tag").alias(f"{side}_tag"), F.col("nick").alias(f"{side}_nick"))
        edges = edges.join(own, side, "left").withColumn(f"{side}_tag", F.coalesce(f"{side}_tag", F.lit("NODE")))
    return edges


def pattern_pairs(graph: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs(a_tag, a_key, a_value, b_tag, b_key, b_value)`` with ``a``, ``a_hits``, ``b``, ``b_hits``.

    Each side names nodes by one property; ``a`` and ``b`` are null unless one node alone matches.
    """
    for side in ("a", "b"):
        keys = [f"{side}_tag", f"{side}_key", f"{side}_value"]
        asked = pairs.select(*keys).distinct()
        found = (
            graph.nodes.select("hid", F.col("tag").alias(keys[0]), F.explode("props").alias(keys[1], keys[2]))
            .join(asked, keys)
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias(f"{side}_hits"), F.min("hid").alias(side))
            .withColumn(side, F.when(F.col(f"{side}_hits") == 1, F.col(side)))
        )
        pairs = pairs.join(found, keys, "left").withColumn(f"{side}_hits", F.coalesce(f"{side}_hits", F.lit(0).cast("long")))
    return pairs


def match_edges(graph: Graph, relation: str | None = None, src: str | None = None, dist: str | None = None, where: Column | None = None) -> DataFrame:
    """Edges by relation, ends and a predicate over their properties."""
    out = graph.edges
    if relation is not None:
        out = out.where(P.fold_relation(F.col("relation")) == P.fold_relation(F.lit(relation)))
    if src is not None:
        out = out.where(F.col("src") == src)
    if dist is not None:
        out = out.where(F.col("dist") == dist)
    return out if where is None else out.where(P.holds(where))


def has_relation(graph: Graph, relation: str) -> bool:
    """Whether any edge has this relation; the scan stops at the first."""
    return not match_edges(graph, relation).limit(1).isEmpty()


def fingerprint(query: str, **params: object) -> str:
    """What a cursor is good for: the query and its parameters, in brief."""
    return hashlib.sha256(json.dumps([query, params], sort_keys=True).encode()).hexdigest()[:16]


def _sealed(body: bytes, secret: str) -> bytes:
    return hmac.new(secret.encode(), body, hashlib.sha256).digest()[:12]


def cursor(graph: Graph, secret: str, mark: str, offset: int) -> str:
    """A token for the rows after ``offset``, good for this version and these parameters only."""
    body = json.dumps([graph.version, mark, offset]).encode()
    return base64.b32encode(_sealed(body, secret) + body).decode().rstrip("=").lower()


def resume(graph: Graph, secret: str, mark: str, token: str) -> int:
    """The offset in a token; ``bad_cursor`` for a forged or foreign one, ``stale_cursor`` after a write."""
    try:
        raw = base64.b32decode(token.upper() + "=" * (-len(token) % 8))
        seal, body = raw[:12], raw[12:]
        version, own, offset = json.loads(body)
    except ValueError as wrong:
        raise GraphError("bad_cursor", "not a cursor") from wrong
    if not hmac.compare_digest(seal, _sealed(body, secret)) or own != mark:
        raise GraphError("bad_cursor", "made for another query")
    if version != graph.version:
        raise GraphError("stale_cursor", f"made for version {version}, the graph has {graph.version}")
    return offset


#: Fixed value: digits of base 32 (RFC 4648), small.
_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def handles(rows: DataFrame, secret: str, kind: str = "node") -> DataFrame:
    """``rows(hid, props)`` with ``handle``: ``h_`` and 26 digits of an HMAC-SHA256 of nickname or handle.

    The keyed hash and base 32 are built-in functions over whole columns.
    """
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    said = F.concat(F.lit(f"{kind}:"), F.coalesce(nickname(), F.col("hid"))).cast("binary")
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256)
    two = lambda i: F.conv(F.substr(F.col("mac"), F.floor(i * 5 / 4).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
    digit = lambda i: F.floor(two(i) / F.element_at(F.array(*(F.lit(8 >> (5 * k % 4)) for k in range(4))), (i % 4 + 1).cast("int"))).cast("int") % 32
    letters = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substr(F.lit(_BASE32), digit(i) + 1, F.lit(1)))
    return rows.withColumn("mac", mac).withColumn("handle", F.concat(F.lit("h_"), F.array_join(letters, ""))).drop("mac")


def by_handle(graph: Graph, secret: str, handle: str) -> DataFrame:
    """The nodes with this handle."""
    return handles(graph.nodes, secret).where(F.col("handle") == handle).drop("handle")
