"""The registered queries over the star-schema graph, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import props as P
from ..functions import text as T
from ..model import Graph, from_rows, nickname
from ..operators import census, changes, emit, govern, merging, seeds, walks
from ..sources import artefacts, star
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The graph of :mod:`..sources.star` in SQL.
GRAPH = """
WITH RECURSIVE nodes AS (
  SELECT 'REG_' || r_regionkey AS hid, 'REG' AS tag, MAP {'id': 'REG_' || r_regionkey, 'name': r_name} AS props FROM region
  UNION ALL SELECT 'NAT_' || n_nationkey, 'NAT', MAP {'id': 'NAT_' || n_nationkey, 'name': n_name} FROM nation
  UNION ALL SELECT 'CUS_' || c_custkey, 'CUS', MAP {'id': 'CUS_' || c_custkey, 'name': c_name, 'segment': c_mktsegment, 'acctbal': c_acctbal::DECIMAL(18,2)::VARCHAR} FROM customer
  UNION ALL SELECT 'SUP_' || s_suppkey, 'SUP', MAP {'id': 'SUP_' || s_suppkey, 'name': s_name, 'acctbal': s_acctbal::DECIMAL(18,2)::VARCHAR} FROM supplier
  UNION ALL SELECT 'ORD_' || o_orderkey, 'ORD', MAP {'id': 'ORD_' || o_orderkey, 'status': o_orderstatus, 'priority': o_orderpriority, 'orderdate': strftime(o_orderdate, '%Y-%m-%d'), 'totalprice': o_totalprice::DECIMAL(18,2)::VARCHAR, 'recycle': CASE WHEN o_orderstatus = 'F' THEN 'delete_on_settle' ELSE 'persistent' END} FROM orders
  UNION ALL SELECT 'PRT_' || p_partkey, 'PRT', MAP {'id': 'PRT_' || p_partkey, 'name': p_name, 'brand': p_brand, 'type': p_type, 'size': p_size::VARCHAR, 'retailprice': p_retailprice::DECIMAL(18,2)::VARCHAR} FROM part
  UNION ALL SELECT 'USR_' || user_id, 'USR', MAP {'id': 'USR_' || user_id, 'first': strftime(min(ts), '%Y-%m-%d'), 'events': count(*)::VARCHAR} FROM events GROUP BY user_id
), edges AS (
  SELECT 'partOf:NAT_' || n_nationkey || '>REG_' || n_regionkey AS hid, 'partOf' AS relation, 'NAT_' || n_nationkey AS src, 'REG_' || n_regionkey AS dist, MAP {}::MAP(VARCHAR, VARCHAR) AS props FROM nation
  UNION ALL SELECT 'partOf:CUS_' || c_custkey || '>NAT_' || c_nationkey, 'partOf', 'CUS_' || c_custkey, 'NAT_' || c_nationkey, MAP {} FROM customer
  UNION ALL SELECT 'partOf:SUP_' || s_suppkey || '>NAT_' || s_nationkey, 'partOf', 'SUP_' || s_suppkey, 'NAT_' || s_nationkey, MAP {} FROM supplier
  UNION ALL SELECT 'placed:CUS_' || o_custkey || '>ORD_' || o_orderkey, 'placed', 'CUS_' || o_custkey, 'ORD_' || o_orderkey, MAP {} FROM orders
  UNION ALL SELECT DISTINCT 'contains:ORD_' || l_orderkey || '>PRT_' || l_partkey, 'contains', 'ORD_' || l_orderkey, 'PRT_' || l_partkey, MAP {}::MAP(VARCHAR, VARCHAR) FROM lineitem
  UNION ALL SELECT DISTINCT 'suppliedBy:PRT_' || l_partkey || '>SUP_' || l_suppkey, 'suppliedBy', 'PRT_' || l_partkey, 'SUP_' || l_suppkey, MAP {}::MAP(VARCHAR, VARCHAR) FROM lineitem
  UNION ALL SELECT DISTINCT 'ships:SUP_' || l_suppkey || '>ORD_' || l_orderkey || ':' || l_partkey || ':' || l_linenumber, 'ships', 'SUP_' || l_suppkey, 'ORD_' || l_orderkey, MAP {'part': l_partkey::VARCHAR, 'line': l_linenumber::VARCHAR} FROM lineitem
), ranked AS (
  SELECT *, list_sort(list_filter(map_entries(props), lambda p: p.key NOT IN ('id', 'src', 'dist', 'hid', 'elementId'))) AS pairs FROM nodes
)"""


def query(sql: str | None = None, graph: bool = True) -> Callable:
    """Register a function of a graph (or of session and folder) under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (lambda spark, folder: f(star.load(spark, folder))) if graph else f
        if sql:
            ORACLE_SQL[f.__name__] = GRAPH + sql if graph else sql
        return f

    return add


def _props(df: DataFrame, *keys: str) -> DataFrame:
    first = [c for c in df.columns if c != "props"]
    return df.select(*first, *(P.value(k).alias(k) for k in keys))


# Finding


@query("""
SELECT row_number() OVER (ORDER BY tag, pairs, hid) AS position, hid, tag, props['name'] AS name
FROM ranked WHERE tag = 'CUS' AND props['segment'] = 'BUILDING' QUALIFY position <= 50""")
def find_kind(g: Graph) -> DataFrame:
    """The first fifty customers of a segment by rank."""
    return _props(seeds.find(g, kind="cus", locators={"segment": "BUILDING"}, limit=50), "name")


@query("""
SELECT row_number() OVER (ORDER BY tag, pairs, hid) AS position, hid, tag, props['name'] AS name
FROM ranked WHERE tag = 'CUS' AND props['segment'] = 'BUILDING' QUALIFY position > 50 AND position <= 100""")
def find_page2(g: Graph) -> DataFrame:
    """The second page of the same find, by a cursor."""
    mark = seeds.fingerprint("find", kind="cus", locators={"segment": "BUILDING"})
    offset = seeds.resume(g, "key", mark, seeds.cursor(g, "key", mark, 50))
    return _props(seeds.find(g, kind="cus", locators={"segment": "BUILDING"}, limit=50, offset=offset), "name")


@query("""
SELECT row_number() OVER (ORDER BY tag, pairs, hid) AS position, hid, tag
FROM ranked WHERE list_bool_or(list_transform(map_values(props), lambda v: contains(lower(v), 'build'))) QUALIFY position <= 40""")
def find_keyword(g: Graph) -> DataFrame:
    """Nodes of any kind that mention a word."""
    return seeds.find(g, keyword="BUILD", limit=40).select("position", "hid", "tag")


@query("""
SELECT count(*) AS hits FROM nodes WHERE tag = 'ORD' AND props['status'] = 'O' AND props['priority'] = '1-URGENT'""")
def find_cardinality(g: Graph) -> DataFrame:
    """How many rows a find without limit has."""
    return seeds.cardinality(g, kind="ORD", locators={"status": "O", "priority": "1-URGENT"})


@query("""
SELECT hid, props['name'] AS name FROM nodes WHERE tag = 'CUS' AND props['name'] LIKE '%1_' AND props['segment'] LIKE '%E%'""")
def list_glob(g: Graph) -> DataFrame:
    """All customers whose properties match globs."""
    return _props(seeds.list_records(g, "CUS", where={"name": "*1?", "segment": "*E*"}).drop("tag"), "name")


@query("""
SELECT hid, tag, props['brand'] AS brand, props['size'] AS size FROM nodes WHERE tag = 'PRT' AND props['size'] = '7' AND props['brand'] = 'Brand#13'""")
def list_exact_and(g: Graph) -> DataFrame:
    """Parts with two exact properties."""
    return _props(seeds.list_records(g, "PRT", where={"size": "7", "brand": "Brand#13"}), "brand", "size")


@query("""
SELECT hid, tag FROM nodes WHERE tag = 'ORD' AND coalesce(props['recycle'], '') NOT IN ('delete_on_settle', 'delete_on_expire')""")
def active_only(g: Graph) -> DataFrame:
    """Orders that may not go."""
    return seeds.list_records(g, "ORD", active_only=True).select("hid", "tag")


@query("""
SELECT hid, props['segment'] AS segment FROM nodes WHERE tag = 'CUS' AND props['segment'] = 'MACHINERY'""")
def match_pattern(g: Graph) -> DataFrame:
    """Nodes with a label and a property."""
    return _props(seeds.match_nodes(g, "CUS", {"segment": "MACHINERY"}).select("hid", "props"), "segment")


# Predicates


def _where(g: Graph, tag: str, predicate, *keys: str) -> DataFrame:
    return _props(g.nodes.where(F.col("tag") == tag).where(P.holds(predicate)).select("hid", "props"), *keys)


@query("""
SELECT hid FROM nodes WHERE tag = 'SUP' AND coalesce(props['segment'], '') = '' AND coalesce(props['note'], '') <> 'x'""")
def where_eq_ne_missing(g: Graph) -> DataFrame:
    """A missing property equals the empty text and differs from every other."""
    return _where(g, "SUP", P.equals("segment", "") & P.differs("note", "x"))


@query("SELECT hid, props['name'] AS name FROM nodes WHERE tag = 'PRT' AND contains(coalesce(props['name'], ''), 'a')")
def where_contains(g: Graph) -> DataFrame:
    return _where(g, "PRT", P.contains("name", "a"), "name")


@query("SELECT hid FROM nodes WHERE tag = 'CUS' AND (starts_with(props['segment'], 'AUTO') OR suffix(props['name'], '7'))")
def where_starts_ends(g: Graph) -> DataFrame:
    return _where(g, "CUS", P.starts_with("segment", "AUTO") | P.ends_with("name", "7"))


@query("SELECT hid, props['name'] AS name FROM nodes WHERE tag = 'CUS' AND regexp_matches(props['name'], '0[13]+$')")
def where_regex(g: Graph) -> DataFrame:
    return _where(g, "CUS", P.matches("name", "0[13]+$"), "name")


@query("""
SELECT hid FROM (SELECT hid, CASE WHEN (regexp_extract(hid, '\\d+$')::BIGINT) % 2 = 0 THEN '["' || props['segment'] || '","all"]' ELSE props['segment'] || ', some' END AS l FROM nodes WHERE tag = 'CUS')
WHERE list_contains(CASE WHEN l LIKE '[%' THEN from_json(l, '["VARCHAR"]') ELSE list_transform(string_split(l, ','), lambda s: trim(s)) END, 'FURNITURE')""")
def where_in_list(g: Graph) -> DataFrame:
    """Membership in properties that are JSON arrays or lists between commas."""
    even = F.regexp_extract("hid", r"\d+$", 0).cast("long") % 2 == 0
    text = F.when(even, F.concat(F.lit('["'), P.value("segment"), F.lit('","all"]'))).otherwise(F.concat(P.value("segment"), F.lit(", some")))
    rows = g.nodes.where("tag = 'CUS'").select("hid", F.create_map(F.lit("l"), text).alias("props"))
    return rows.where(P.holds(P.lists("l", "FURNITURE"))).select("hid")


@query("""
SELECT hid FROM nodes WHERE (tag = 'ORD' AND TRY_CAST(props['totalprice'] AS DOUBLE) >= 100000) OR (tag = 'PRT' AND TRY_CAST(props['size'] AS BIGINT) < 5)""")
def where_range_num(g: Graph) -> DataFrame:
    """Number ranges; what has no number is unknown and left out."""
    return g.nodes.where(P.holds(((F.col("tag") == "ORD") & P.compares("totalprice", ">=", 100000)) | ((F.col("tag") == "PRT") & P.compares("size", "<", 5)))).select("hid")


@query("SELECT hid, props['orderdate'] AS orderdate FROM nodes WHERE tag = 'ORD' AND props['orderdate'] > '1995-06-30' AND props['orderdate'] <= '1996-03-01'")
def where_range_str(g: Graph) -> DataFrame:
    """Text ranges by code point."""
    return _where(g, "ORD", P.compares("orderdate", ">", "1995-06-30") & P.compares("orderdate", "<=", "1996-03-01"), "orderdate")


@query("""
SELECT tag, count(*) AS n FROM nodes WHERE NOT (TRY_CAST(props['acctbal'] AS DOUBLE) > 0) GROUP BY tag""")
def where_3vl_not(g: Graph) -> DataFrame:
    """Not of unknown is unknown: rows without a balance are neither above nor not above 0."""
    return g.nodes.where(P.holds(~P.compares("acctbal", ">", 0))).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT hid FROM nodes WHERE tag = 'CUS' AND (props['segment'] = 'BUILDING' OR (NOT (TRY_CAST(props['acctbal'] AS DOUBLE) < 5000) AND (starts_with(props['segment'], 'M') OR contains(props['name'], '9'))))""")
def where_nested(g: Graph) -> DataFrame:
    return _where(g, "CUS", P.equals("segment", "BUILDING") | (~P.compares("acctbal", "<", 5000) & (P.starts_with("segment", "M") | P.contains("name", "9"))))


# Lookups and joins


@query("""
SELECT token, CASE WHEN n.hid IS NOT NULL THEN n.hid END AS hid, CASE WHEN n.hid IS NULL THEN 0 ELSE 1 END::BIGINT AS hits
FROM (SELECT 'CUS_' || o_custkey AS token FROM orders UNION SELECT 'SUP_' || (o_custkey + 5) FROM orders) t LEFT JOIN nodes n ON n.hid = t.token""")
def resolve_unique_nick(g: Graph) -> DataFrame:
    """Tokens settled by handle or by a nickname that one row has alone."""
    customers = g.edges.where("relation = 'placed'").select("src").distinct()
    number = F.regexp_extract("src", r"\d+$", 0).cast("long")
    tokens = customers.select(F.col("src").alias("token")).union(customers.select(F.concat(F.lit("SUP_"), (number + 5).cast("string"))))
    return seeds.resolve(g, tokens.distinct()).select("token", "hid", "hits")


@query("""
SELECT props['segment'] AS nick, count(*) AS rows FROM nodes WHERE tag = 'CUS' GROUP BY 1 UNION ALL SELECT hid, 1 FROM nodes WHERE tag = 'NAT'""")
def nick_duplicates(g: Graph) -> DataFrame:
    """Nicknames and how many rows share them, with customers named by segment."""
    named = g.nodes.where("tag in ('CUS', 'NAT')").withColumn("props", F.when(F.col("tag") == "CUS", F.create_map(F.lit("id"), P.value("segment"))).otherwise(F.col("props")))
    return seeds.nicknames(Graph(named, g.edges.where(F.lit(False)), g.limits))


@query("SELECT regexp_extract(hid, '^[A-Za-z_]+') AS prefix, max(regexp_extract(hid, '\\d+$')::BIGINT) AS high FROM nodes GROUP BY 1")
def id_high_water(g: Graph) -> DataFrame:
    return seeds.high_water(g)


@query("SELECT src AS at, dist AS far, hid AS edge, relation, true AS forward FROM edges WHERE relation = 'placed'")
def adj_out(g: Graph) -> DataFrame:
    return seeds.adjacency(g.edges, "PLACED", "out")


@query("SELECT dist AS at, src AS far, hid AS edge, relation, false AS forward FROM edges WHERE relation = 'suppliedBy'")
def adj_in(g: Graph) -> DataFrame:
    return seeds.adjacency(g.edges, "SUPPLIED_BY", "in")


@query("""
SELECT src AS at, dist AS far, hid AS edge, relation, true AS forward FROM edges WHERE relation = 'partOf'
UNION ALL SELECT dist, src, hid, relation, false FROM edges WHERE relation = 'partOf' AND src <> dist""")
def adj_both(g: Graph) -> DataFrame:
    return seeds.adjacency(g.edges, "partOf", "both")


@query("""
SELECT e.hid, e.src, e.dist, coalesce(a.tag, 'NODE') AS src_tag, coalesce(b.tag, 'NODE') AS dist_tag, a.hid AS src_nick, b.hid AS dist_nick
FROM edges e LEFT JOIN nodes a ON a.hid = e.src LEFT JOIN nodes b ON b.hid = e.dist WHERE relation IN ('contains', 'partOf')""")
def edge_endpoint_join(g: Graph) -> DataFrame:
    """Edges with both ends resolved."""
    return seeds.endpoints(g, g.edges.where("relation in ('contains', 'partOf')")).select("hid", "src", "dist", "src_tag", "dist_tag", "src_nick", "dist_nick")


@query("""
SELECT c.hid AS a, n.hid AS b FROM nodes c, nodes n WHERE c.tag = 'CUS' AND n.tag = 'NAT' AND n.hid = 'NAT_' || (regexp_extract(c.hid, '\\d+$')::BIGINT % 30)""")
def pattern_pair(g: Graph) -> DataFrame:
    """Pairs of nodes by one property each, both settled."""
    c = g.nodes.where("tag = 'CUS'")
    nation = F.concat(F.lit("NAT_"), (F.regexp_extract("hid", r"\d+$", 0).cast("long") % 30).cast("string"))
    pairs = c.select(F.lit("CUS").alias("a_tag"), F.lit("name").alias("a_key"), P.value("name").alias("a_value"), F.lit("NAT").alias("b_tag"), F.lit("id").alias("b_key"), nation.alias("b_value"))
    return seeds.pattern_pairs(g, pairs).where("a is not null and b is not null").select("a", "b")


@query("SELECT hid, src, dist FROM edges WHERE relation = 'ships' AND src = 'SUP_3' AND props['line'] <> '1'")
def rel_pattern_match(g: Graph) -> DataFrame:
    """Edges by relation, end and a property."""
    return seeds.match_edges(g, "ships", src="SUP_3", where=P.differs("line", "1")).select("hid", "src", "dist")


# Census


def _broken(g: Graph) -> Graph:
    """The graph without every tenth customer, whose edges dangle then."""
    gone = (F.col("tag") == "CUS") & (F.regexp_extract("hid", r"\d+$", 0).cast("long") % 10 == 0)
    return Graph(g.nodes.where(~gone), g.edges, g.limits)


BROKEN = """, live AS (SELECT * FROM nodes WHERE NOT (tag = 'CUS' AND regexp_extract(hid, '\\d+$')::BIGINT % 10 = 0)),
dang AS (SELECT * FROM edges e WHERE e.src NOT IN (SELECT hid FROM live) OR e.dist NOT IN (SELECT hid FROM live)),
orph AS (SELECT * FROM live WHERE hid NOT IN (SELECT src FROM edges) AND hid NOT IN (SELECT dist FROM edges))"""


@query(BROKEN + " SELECT hid, relation, src, dist FROM dang")
def dangling(g: Graph) -> DataFrame:
    return census.dangling(_broken(g)).select("hid", "relation", "src", "dist")


@query(BROKEN + " SELECT hid, tag FROM orph")
def orphans(g: Graph) -> DataFrame:
    return census.orphans(_broken(g)).select("hid", "tag")


@query(BROKEN + """
SELECT hid, CASE min(i) WHEN 0 THEN 'recyclable' WHEN 1 THEN 'dangling' ELSE 'orphan' END AS reason FROM (
SELECT hid, 0 AS i FROM live WHERE props['recycle'] IN ('delete_on_settle', 'delete_on_expire') UNION ALL SELECT hid, 1 FROM dang UNION ALL SELECT hid, 2 FROM orph) GROUP BY hid""")
def stale_union(g: Graph) -> DataFrame:
    return census.stale(_broken(g))


@query(BROKEN + """
SELECT (SELECT count(*) FROM live) + (SELECT count(*) FROM edges) AS rows, 0::BIGINT AS laws, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT relation) FROM edges) AS relations,
(SELECT count(*) FROM live WHERE props['recycle'] IN ('delete_on_settle', 'delete_on_expire')) AS recyclable, (SELECT count(*) FROM dang) AS dangling, (SELECT count(*) FROM orph) AS orphans""")
def hk_stats(g: Graph) -> DataFrame:
    return census.stats(_broken(g))


@query("""
, live AS (SELECT * FROM ranked WHERE coalesce(props['recycle'], '') NOT IN ('delete_on_settle', 'delete_on_expire')),
k AS (SELECT tag, hid, row_number() OVER (PARTITION BY tag ORDER BY pairs, hid) AS k, count(*) OVER (PARTITION BY tag) AS n FROM live)
SELECT row_number() OVER (ORDER BY tag, k) AS position, tag, n, hid FROM k WHERE k <= 3""")
def outline(g: Graph) -> DataFrame:
    """Kinds, how many there are of each, and three of them."""
    return census.outline(g)


@query("SELECT tag, count(*) AS n FROM nodes GROUP BY tag UNION ALL SELECT 'EDG', count(*) FROM edges")
def kind_counts(g: Graph) -> DataFrame:
    return census.kind_counts(g)


@query("""
SELECT tag, key, count(*) AS n FROM (SELECT tag, unnest(map_keys(props)) AS key FROM nodes UNION ALL SELECT 'EDG', unnest(list_concat(map_keys(props), ['src', 'dist', 'relation'])) FROM edges) GROUP BY ALL""")
def field_key_counts(g: Graph) -> DataFrame:
    return census.field_counts(g)


RHO = """, alive AS (SELECT hid FROM nodes WHERE coalesce(props['recycle'], '') NOT IN ('delete_on_settle', 'delete_on_expire')),
e AS (SELECT hid, src, dist FROM edges WHERE relation <> 'contains' AND src IN (SELECT hid FROM alive) AND dist IN (SELECT hid FROM alive)),
s AS (SELECT src AS node, dist AS far FROM e UNION ALL SELECT dist, src FROM e WHERE src <> dist),
rho AS (SELECT node AS hid, count(*) AS rho FROM s GROUP BY node)"""


@query(RHO + " SELECT n.hid, coalesce(rho, 0) AS rho FROM nodes n LEFT JOIN rho ON rho.hid = n.hid")
def residual_degree(g: Graph) -> DataFrame:
    return census.residual_degree(g)


@query(RHO + """ SELECT r.hid, r.rho FROM rho r WHERE r.rho >= (SELECT coalesce(max(q.rho), 0) FROM s JOIN rho q ON q.hid = s.far WHERE s.node = r.hid AND s.far <> r.hid)""")
def peak_l(g: Graph) -> DataFrame:
    """Nodes with more edges than any neighbour."""
    return census.peaks(g)


@query("""
SELECT tag, count(*) AS rows, sum(b)::BIGINT AS bytes FROM (
SELECT tag, strlen(tag) + 1 + list_sum(list_transform(map_values(props), lambda v: strlen(replace(replace(v, '\\', '\\\\'), '|', '\\|')) + 1)) AS b FROM nodes
UNION ALL SELECT 'EDG', 4 + strlen(src) + strlen(dist) + strlen(relation) + 3 + coalesce(list_sum(list_transform(map_values(props), lambda v: strlen(v) + 1)), 0) FROM edges) GROUP BY tag""")
def byte_total(g: Graph) -> DataFrame:
    """What the rows of each tag weigh as lines."""
    return census.byte_totals(g)


# Walks


def _regions(g: Graph) -> DataFrame:
    return walks.seeds_of(g, g.nodes.where("tag = 'REG'"))


def _nations(g: Graph) -> DataFrame:
    return walks.seeds_of(g, g.nodes.where("tag = 'NAT'"))


@query("""
SELECT n.hid AS seed, n.hid AS node, 0 AS hop FROM nodes n WHERE tag = 'NAT' UNION ALL
SELECT DISTINCT n.hid, CASE WHEN e.src = n.hid THEN e.dist ELSE e.src END, 1 FROM nodes n JOIN edges e ON e.src = n.hid OR e.dist = n.hid WHERE tag = 'NAT'""")
def neighbors_1(g: Graph) -> DataFrame:
    """Everything one edge away from each nation."""
    return walks.neighbours(g, _nations(g), 1).select("seed", "node", "hop")


@query("""
, s AS (SELECT src AS at, dist AS far FROM edges WHERE relation = 'partOf' UNION SELECT dist, src FROM edges WHERE relation = 'partOf'),
w AS (SELECT hid AS seed, hid AS node, 0 AS hop FROM nodes WHERE tag = 'REG' UNION SELECT w.seed, s.far, w.hop + 1 FROM w JOIN s ON s.at = w.node WHERE w.hop < 2)
SELECT seed, node, min(hop) AS hop FROM w GROUP BY ALL""")
def neighbors_2(g: Graph) -> DataFrame:
    """Everything two edges away from each region, over the tree of places."""
    return walks.neighbours(Graph(g.nodes, g.edges.where("relation = 'partOf'"), g.limits), _regions(g), 2).select("seed", "node", "hop")


@query("""
, o AS (SELECT e.*, row_number() OVER (PARTITION BY src ORDER BY relation, n.tag, n.pairs, list_sort(map_entries(e.props)), e.hid) AS k FROM edges e JOIN ranked n ON n.hid = e.dist WHERE src LIKE 'SUP%'),
f AS (SELECT src, dist FROM o WHERE k <= 5 UNION SELECT dist, src FROM edges WHERE dist LIKE 'SUP%' AND src <> dist)
SELECT hid AS seed, hid AS node, 0 AS hop FROM nodes WHERE tag = 'SUP' UNION ALL SELECT DISTINCT src, dist, 1 FROM f""")
def fanout_clamp(g: Graph) -> DataFrame:
    """Suppliers' neighbours when of the edges outwards five count; those inwards are not cut."""
    return walks.neighbours(g, walks.seeds_of(g, g.nodes.where("tag = 'SUP'")), 1, fanout=5, path=False).select("seed", "node", "hop")


@query("""

, e AS (SELECT src AS pack, hid, dist, relation FROM edges WHERE src LIKE 'CUS%'),
p AS (SELECT hid AS pack, 0 AS part, hid, tag, pairs, '' AS relation, [{'t': '', 'p': pairs[1:0]}] AS k FROM ranked WHERE tag = 'CUS'
UNION ALL SELECT e.pack, 1, n.hid, n.tag, n.pairs, '', [{'t': '', 'p': n.pairs[1:0]}] FROM e JOIN ranked n ON n.hid = e.dist
UNION ALL SELECT e.pack, 2, e.hid, 'EDG', n.pairs[1:0], e.relation, [{'t': n.tag, 'p': n.pairs}] FROM e JOIN ranked n ON n.hid = e.dist),
q AS (SELECT pack, row_number() OVER (PARTITION BY pack ORDER BY part, tag, relation, k, pairs, hid) AS position, CASE part WHEN 0 THEN 'seed' WHEN 1 THEN 'node' ELSE 'edge' END AS part, hid, tag FROM p)
SELECT * FROM q WHERE position <= 12""")
def context_pack(g: Graph) -> DataFrame:
    """Each customer's surroundings: itself, what is one edge away, and the edges; twelve rows at most."""
    anchors = g.nodes.where("tag = 'CUS'").select(F.col("hid").alias("pack"), F.col("hid").alias("node"))
    return walks.context_pack(g, anchors, depth=1, max_rows=12).select("pack", "position", "part", "hid", "tag")


@query()
def shell_cap(g: Graph) -> DataFrame:
    """Packs of regions cut to eight nodes and twelve edges."""
    anchors = g.nodes.where("tag = 'REG'").select(F.col("hid").alias("pack"), F.col("hid").alias("node"))
    return walks.shell(walks.context_pack(g, anchors, depth=2), g).select("pack", "position", "part", "hid", "tag")


@query("""
SELECT c.hid AS seed, 1 AS hop, e.dist AS far, e.hid AS edge FROM nodes c JOIN edges e ON e.src = c.hid AND e.relation = 'partOf' WHERE c.tag = 'CUS'
UNION ALL SELECT c.hid, 2, f.dist, f.hid FROM nodes c JOIN edges e ON e.src = c.hid AND e.relation = 'partOf' JOIN edges f ON f.src = e.dist AND f.relation = 'partOf' WHERE c.tag = 'CUS'""")
def walk_out(g: Graph) -> DataFrame:
    """From every customer to nation and region."""
    return walks.typed_walk(g, walks.seeds_of(g, g.nodes.where("tag = 'CUS'")), "PART_OF", "out", 1, 2).select("seed", "hop", "far", "edge")


@query("""
, w AS (SELECT r.hid AS seed, 1 AS hop, e.src AS far, [e.hid] AS path FROM nodes r JOIN edges e ON e.dist = r.hid AND e.relation = 'partOf' WHERE r.tag = 'REG'
UNION ALL SELECT w.seed, 2, e.src, list_append(w.path, e.hid) FROM w JOIN edges e ON e.dist = w.far AND e.relation = 'partOf' WHERE w.hop = 1)
SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY hop, path) AS row, hop, far FROM w QUALIFY row <= 500""")
def walk_in(g: Graph) -> DataFrame:
    """Against the edges: from regions to nations, customers and suppliers, in the order of the walk."""
    return walks.typed_walk(g, _regions(g), "partOf", "in", 1, 2).select("seed", "row", "hop", "far")


@query("""
, s AS (SELECT src AS at, dist AS far FROM edges WHERE relation = 'partOf' UNION SELECT dist, src FROM edges WHERE relation = 'partOf'),
w AS (SELECT hid AS seed, hid AS node, 0 AS hop FROM nodes WHERE tag = 'REG' UNION SELECT w.seed, s.far, w.hop + 1 FROM w JOIN s ON s.at = w.node WHERE w.hop < 3)
SELECT seed, node AS far, min(hop) AS hop FROM w GROUP BY ALL HAVING min(hop) > 0""")
def walk_both(g: Graph) -> DataFrame:
    return walks.typed_walk(g, _regions(g), "partOf", "both", 1, 3, limit=10**6).select("seed", "far", "hop")


@query("""
SELECT c.hid AS seed, 2 AS hop, f.dist AS far FROM nodes c JOIN edges e ON e.src = c.hid AND e.relation = 'partOf' JOIN edges f ON f.src = e.dist AND f.relation = 'partOf' WHERE c.tag = 'SUP'""")
def walk_min_hops(g: Graph) -> DataFrame:
    return walks.typed_walk(g, walks.seeds_of(g, g.nodes.where("tag = 'SUP'")), "partOf", "out", 2, 2).select("seed", "hop", "far")


@query("""
SELECT r.hid AS seed, 2 AS hop, f.src AS far FROM nodes r JOIN edges e ON e.dist = r.hid AND e.relation = 'partOf' JOIN edges f ON f.dist = e.src AND f.relation = 'partOf'
JOIN nodes n ON n.hid = f.src WHERE r.tag = 'REG' AND n.props['segment'] = 'BUILDING'""")
def walk_where_end(g: Graph) -> DataFrame:
    """What the predicate leaves out is walked through all the same."""
    return walks.typed_walk(g, _regions(g), "partOf", "in", 1, 2, where=P.equals("segment", "BUILDING"), limit=10**6).select("seed", "hop", "far")


@query("""
, q AS (SELECT 'CUS_' || c_custkey AS src, 'REG_' || (c_custkey % 5) AS dist FROM customer)
SELECT q.src, q.dist, CASE WHEN f.dist IS NULL THEN NULL ELSE 2 END AS hops, CASE WHEN f.dist IS NOT NULL THEN e.hid || ',' || f.hid END AS edges
FROM q LEFT JOIN edges e ON e.src = q.src AND e.relation = 'partOf' LEFT JOIN edges f ON f.src = e.dist AND f.dist = q.dist AND f.relation = 'partOf'""")
def find_path(g: Graph) -> DataFrame:
    """The shortest way from each customer to one region, over the tree of places."""
    number = F.regexp_extract("hid", r"\d+$", 0).cast("long")
    pairs = g.nodes.where("tag = 'CUS'").select(F.col("hid").alias("src"), F.concat(F.lit("REG_"), (number % 5).cast("string")).alias("dist"))
    found = walks.find_paths(Graph(g.nodes, g.edges.where("relation = 'partOf'"), g.limits), pairs)
    return found.select("src", "dist", "hops", F.array_join(F.transform("path", lambda s: s["edge"]), ",").alias("edges"))


@query("""
SELECT src AS seed, src, relation, dist, hid AS edge FROM edges WHERE relation IN ('partOf', 'placed') AND src LIKE 'CUS%' AND src IN (SELECT hid FROM nodes)""")
def hop_list(g: Graph) -> DataFrame:
    """The hops one edge around each customer."""
    return walks.hop_list(g, walks.seeds_of(g, g.nodes.where("tag = 'CUS'")), depth=1, whole=True)


@query("""
, near AS (SELECT n.hid AS seed, n.hid AS node, 0 AS hop FROM nodes n WHERE tag = 'NAT' UNION ALL
SELECT DISTINCT n.hid, CASE WHEN e.src = n.hid THEN e.dist ELSE e.src END, 1 FROM nodes n JOIN edges e ON e.src = n.hid OR e.dist = n.hid WHERE tag = 'NAT')
SELECT seed, node AS hid FROM near QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, node) <= 20""")
def ego_ids(g: Graph) -> DataFrame:
    """The twenty nearest nodes of each nation."""
    return walks.ego_ids(g, _nations(g), depth=1, max_rows=20)


#: Rules over the graph: one that always holds, one of a region's, one of nobody's, and which ones a walk is to show.
_LAWS = [("LAW01", "engine", "", ""), ("LAW20", "all", "", "*"), ("LAW21", "of a region", "", ""), ("LAW22", "of nobody", "", ""), ("LAW06", "scope", "law_scope", "linked_from_anchor")]


def _ruled(g: Graph) -> Graph:
    nodes = [(i, "LAW", {"id": i, "name": n, "mechanism": m, "constraint": c}) for i, n, m, c in _LAWS]
    laws = from_rows(g.spark, nodes, [("governs:1", "governs", "LAW21", "REG_1", {}), ("applies:1", "applies_to", "LAW21", "NAT_3", {})])
    return changes.append(g, laws.nodes, laws.edges)


@query("""
SELECT hid AS seed, unnest(CASE WHEN hid IN ('REG_1', 'NAT_3') THEN ['LAW01', 'LAW20', 'LAW21'] ELSE ['LAW01', 'LAW20'] END) AS hid FROM nodes WHERE tag IN ('REG', 'NAT')""")
def linked_laws(g: Graph) -> DataFrame:
    """The rules that regions and nations are tied to, and those that always hold."""
    g = _ruled(g)
    return walks.linked_laws(g, walks.seeds_of(g, g.nodes.where("tag in ('REG', 'NAT')")), 4)


TREE = """, tree AS (SELECT hid AS root, hid, 0 AS hop FROM nodes WHERE tag = 'REG' UNION ALL SELECT 'REG_' || n_regionkey, 'NAT_' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'REG_' || n_regionkey, 'CUS_' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'REG_' || n_regionkey, 'SUP_' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'REG_' || n_regionkey, 'ORD_' || o_orderkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _members(g: Graph) -> DataFrame:
    return walks.partition(g, g.nodes.where("tag = 'REG'"), [("partOf", "in"), ("placed", "out")])


@query(TREE + " SELECT hid, root, CASE WHEN count(*) OVER (PARTITION BY root) > 100 THEN split_part(hid, '_', 1) ELSE 'all' END AS band FROM tree")
def snap_partition(g: Graph) -> DataFrame:
    """Every place, customer and order under its region, in bands by tag where a region is large."""
    return walks.snap(g, _members(g))


@query(TREE + """ SELECT e.hid AS edge, e.relation, e.src, e.dist, a.root AS src_root, b.root AS dist_root
FROM edges e JOIN tree a ON a.hid = e.src JOIN tree b ON b.hid = e.dist WHERE e.relation = 'ships' AND a.root <> b.root""")
def cross_cuts(g: Graph) -> DataFrame:
    """Deliveries from one region to another."""
    return walks.cross_cuts(g, _members(g), "ships")


# Writes


def _map(*pairs) -> F.Column:
    return F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))


@query("""
SELECT hid, tag, props['name'] AS name FROM nodes WHERE tag IN ('NAT', 'REG') UNION ALL SELECT 'NAT_' || (24 + i), 'NAT', 'new ' || i FROM range(1, 4) t(i)""")
def commit_create(g: Graph) -> DataFrame:
    """Three nations added; their handles go on where the numbers in use end."""
    rows = g.spark.createDataFrame([("nat", {"name": f"new {i}"}) for i in range(1, 4)], "tag string, props map<string,string>")
    return _props(changes.create_nodes(g, rows).nodes.where("tag in ('NAT', 'REG')"), "name")


@query("""
SELECT relation, src, dist, coalesce(props['since'], '') AS since FROM edges WHERE relation = 'partOf' UNION ALL SELECT 'visits', 'CUS_1', 'NAT_1', '2024'""")
def commit_create_edge(g: Graph) -> DataFrame:
    """An edge added; its ends are named by nicknames."""
    rows = g.spark.createDataFrame([("VISITS", "CUS_1", "NAT_1", {"since": "2024"})], "relation string, src string, dist string, props map<string,string>")
    after = changes.create_edges(g, rows)
    return _props(after.edges.where("relation in ('partOf', 'visits')").select("relation", "src", "dist", "props"), "since")


@query("SELECT hid, CASE WHEN hid = 'CUS_7' THEN 'VIP' ELSE props['segment'] END AS segment, props['name'] AS name FROM nodes WHERE tag = 'CUS'")
def commit_set(g: Graph) -> DataFrame:
    """A property of one node set; an empty text clears nothing."""
    after = changes.set_node(g, {"segment": "VIP", "name": ""}, tag="CUS", props={"id": "CUS_7"})
    return _props(after.nodes.where("tag = 'CUS'").select("hid", "props"), "segment", "name")


@query("SELECT hid, CASE WHEN src = 'SUP_2' AND props['line'] = '1' THEN 'late' ELSE '' END AS note FROM edges WHERE relation = 'ships'")
def commit_rel_set(g: Graph) -> DataFrame:
    """A property of all edges that match set."""
    after = changes.set_edges(g, {"note": "late"}, relation="ships", src="SUP_2", where=P.equals("line", "1"))
    return _props(after.edges.where("relation = 'ships'").select("hid", "props"), "note")


@query("SELECT hid, src, dist FROM edges WHERE src = 'CUS_11' OR dist = 'CUS_11'")
def commit_delete(g: Graph) -> DataFrame:
    """A node removed; its edges stay and dangle."""
    return census.dangling(changes.delete_node(g, "CUS", {"id": "CUS_11"})).select("hid", "src", "dist")


@query("SELECT hid, src, dist FROM edges WHERE relation = 'partOf' AND NOT (src = 'CUS_11')")
def commit_delete_edge(g: Graph) -> DataFrame:
    after = changes.delete_edge(g, relation="partOf", src="CUS_11")
    return after.edges.where("relation = 'partOf'").select("hid", "src", "dist")


@query("""
SELECT hid, props['name'] AS name, CASE WHEN hid IN ('REG_0', 'REG_1', 'REG_2') THEN 'seen' ELSE '' END AS mark FROM nodes WHERE tag = 'REG' UNION ALL SELECT 'REG_5', 'Elsewhere', 'seen'""")
def commit_merge(g: Graph) -> DataFrame:
    """Regions set by name where they are there, and one added that is not."""
    names = [r[0] for r in g.nodes.where("hid in ('REG_0', 'REG_1', 'REG_2')").select(P.value("name")).collect()]
    rows = g.spark.createDataFrame([("REG", {"name": n, "mark": "seen"}) for n in [*names, "Elsewhere"]], "tag string, props map<string,string>")
    return _props(changes.merge_nodes(g, rows, ["name"]).nodes.where("tag = 'REG'").select("hid", "props"), "name", "mark")


@query("SELECT hid, CASE WHEN hid = 'USR_1' THEN (props['events']::BIGINT + 5)::VARCHAR ELSE props['events'] END AS events FROM nodes WHERE tag = 'USR'")
def commit_add_number(g: Graph) -> DataFrame:
    return _props(changes.add_number(g, "events", 5, "USR", {"id": "USR_1"}).nodes.where("tag = 'USR'").select("hid", "props"), "events")


@query("""
SELECT 'CUS_7' AS hid, 'altered' AS change""")
def commit_dry_run(g: Graph) -> DataFrame:
    """What a write would change."""
    return changes.difference(g, changes.set_node(g, {"segment": "VIP"}, tag="CUS", props={"id": "CUS_7"}))


@query("SELECT hid, tag FROM nodes WHERE tag = 'CUS' AND hid IN (SELECT src FROM edges WHERE relation = 'placed')")
def prune_orphans(g: Graph) -> DataFrame:
    """Customers without orders removed, once they are no part of a nation."""
    g = Graph(g.nodes.where("tag in ('CUS', 'ORD')"), g.edges.where("relation = 'placed'"), g.limits)
    return changes.prune(g, census.orphans(g)).nodes.where("tag = 'CUS'").select("hid", "tag")


def _twins(g: Graph) -> DataFrame:
    """Customers with even numbers go up in the ones before them."""
    number = F.regexp_extract("hid", r"\d+$", 0).cast("long")
    return g.nodes.where("tag = 'CUS'").where(number % 2 == 0).select(F.concat(F.lit("CUS_"), (number - 1).cast("string")).alias("keep"), F.col("hid").alias("drop")).join(g.nodes.select(F.col("hid").alias("keep")), "keep", "left_semi").select("keep", "drop")


TWINS = """, c AS (SELECT hid, regexp_extract(hid, '\\d+$')::BIGINT AS k, props FROM nodes WHERE tag = 'CUS'), p AS (SELECT a.hid AS keep, b.hid AS gone, a.props AS kp, b.props AS dp FROM c a JOIN c b ON b.k = a.k + 1 WHERE b.k % 2 = 0),
m AS (SELECT e.hid, e.relation, coalesce(a.keep, e.src) AS src, coalesce(b.keep, e.dist) AS dist FROM edges e LEFT JOIN p a ON a.gone = e.src LEFT JOIN p b ON b.gone = e.dist)"""


@query(TWINS + """ SELECT c.hid, c.props['name'] AS name, CASE WHEN p.keep IS NULL THEN '' ELSE p.dp['name'] || ', ' || p.dp['id'] END AS aka FROM c LEFT JOIN p ON p.keep = c.hid WHERE c.hid NOT IN (SELECT gone FROM p)""")
def absorb_same_thing(g: Graph) -> DataFrame:
    """Pairs of customers made one, with the names of both."""
    return _props(merging.absorb(g, _twins(g)).nodes.where("tag = 'CUS'").select("hid", "props"), "name", "aka")


@query(TWINS + " SELECT min(hid) AS hid, relation, src, dist FROM m WHERE relation IN ('partOf', 'placed') GROUP BY relation, src, dist")
def fold_duplicate_edges(g: Graph) -> DataFrame:
    """Their edges, moved to the survivor and folded where they have become equal."""
    after = merging.absorb(Graph(g.nodes, g.edges.where("relation in ('partOf', 'placed')"), g.limits), _twins(g))
    return after.edges.select("hid", "relation", "src", "dist")


@query("""
SELECT min(hid) AS hid, src, dist FROM (SELECT hid, CASE WHEN src = 'CUS_2' THEN 'CUS_1' ELSE src END AS src, dist FROM edges WHERE relation IN ('partOf', 'placed')) GROUP BY src, dist""")
def rename_merge(g: Graph) -> DataFrame:
    """A nickname given to a node that another has: the two are one then."""
    after = changes.rename(Graph(g.nodes, g.edges.where("relation in ('partOf', 'placed')"), g.limits), "CUS_2", "CUS_1", merge=True)
    return after.edges.select("hid", "src", "dist")


def _slice(g: Graph) -> Graph:
    """Nations under other handles, each with a customer that the graph doesn't have."""
    nations = g.nodes.where("tag = 'NAT'").select(F.concat(F.lit("x:"), "hid").alias("hid"), "tag", _map("id", nickname(), "name", P.value("name")).alias("props"))
    guests = g.nodes.where("tag = 'NAT'").select(F.concat(F.lit("g:"), "hid").alias("hid"), F.lit("CUS").alias("tag"), _map("id", nickname(), "name", F.concat(F.lit("guest of "), P.value("name"))).alias("props"))
    edges = g.nodes.where("tag = 'NAT'").select(F.concat(F.lit("v:"), "hid").alias("hid"), F.lit("VISITS").alias("relation"), F.concat(F.lit("g:"), "hid").alias("src"), F.concat(F.lit("x:"), "hid").alias("dist"), _map().cast("map<string,string>").alias("props"))
    return Graph(nations.union(guests), edges, g.limits)


@query("""
SELECT 'v:' || hid AS hid, 'visits' AS relation, 'g:' || hid AS src, hid AS dist FROM nodes WHERE tag = 'NAT' UNION ALL SELECT hid, relation, src, dist FROM edges WHERE relation = 'partOf'""")
def import_keep(g: Graph) -> DataFrame:
    """Rows of another graph brought in: nations are known by what they say, guests are new."""
    after = merging.import_slice(g, _slice(g))
    return after.edges.where("relation in ('partOf', 'visits')").select("hid", "relation", "src", "dist")


@query("""
SELECT hid FROM nodes WHERE tag = 'NAT' UNION ALL SELECT 'g:' || hid FROM nodes WHERE tag = 'NAT' UNION ALL SELECT 'x:' || hid FROM nodes WHERE tag = 'NAT'""")
def import_remint(g: Graph) -> DataFrame:
    """The same with new nicknames where they are in use."""
    after = merging.import_slice(g, _slice(g), policy="remint")
    return after.nodes.where("tag = 'NAT' or hid like 'g:%'").select("hid")


# Governance


@query("""
SELECT hid FROM nodes WHERE tag IN ('CUS', 'ORD', 'NAT', 'REG', 'SUP') AND NOT (tag = 'CUS' OR hid IN ('ORD_1', 'REG_1') OR hid IN (SELECT 'NAT_' || n_nationkey FROM nation WHERE n_regionkey = 1)) UNION ALL
SELECT hid FROM edges WHERE relation IN ('placed', 'partOf') AND NOT (relation = 'placed' OR (src IN ('ORD_1', 'REG_1') OR src IN (SELECT 'NAT_' || n_nationkey FROM nation WHERE n_regionkey = 1)) AND (dist IN ('ORD_1', 'REG_1') OR dist IN (SELECT 'NAT_' || n_nationkey FROM nation WHERE n_regionkey = 1)))""")
def scope_violations(g: Graph) -> DataFrame:
    """Rows that a writer of customers, of one order, of placed edges and around one region may not write."""
    near = Graph(g.nodes, g.edges.where("relation = 'partOf' and src like 'NAT%'"), g.limits)
    scope = govern.Scope(ids=("ORD_1",), labels=("CUS",), relations=("placed",), anchors=("REG_1",))
    return govern.scope_violations(near, scope, g.nodes.where("tag in ('CUS', 'ORD', 'NAT', 'REG', 'SUP')"), g.edges.where("relation in ('placed', 'partOf')"))


@query("""
SELECT e.src AS hid, l.rid, l.holder FROM (SELECT DISTINCT src FROM edges WHERE relation = 'placed') e JOIN (SELECT 'CUS_' || c_custkey AS hid, 'r' || c_nationkey AS rid, CASE WHEN c_nationkey % 2 = 0 THEN 'ann' ELSE 'bob' END AS holder, c_nationkey FROM customer) l ON l.hid = e.src WHERE holder <> 'ann' AND l.c_nationkey <> 3""")
def lease_conflicts(g: Graph) -> DataFrame:
    """Customers with orders that another holder's lease covers."""
    nation = F.regexp_extract("dist", r"\d+$", 0).cast("long")
    own = g.edges.where("relation = 'partOf' and src like 'CUS%'")
    leases = own.select(F.concat(F.lit("r"), nation.cast("string")).alias("rid"), F.when(nation % 2 == 0, "ann").otherwise("bob").alias("holder"), F.col("dist").alias("anchor"), F.when(nation == 3, F.lit("2024-01-01")).otherwise(F.lit("2024-02-01")).cast("timestamp").alias("until"), F.col("src").alias("hid"))
    return govern.lease_conflicts(g, leases, g.edges.where("relation = 'placed'").select(F.col("src").alias("hid")), "ann", "2024-01-15 00:00:00")


# Scalars and lines


@query("""
SELECT * FROM (VALUES ('HAS_FACT', 'hasFact'), ('Mixed_1', 'mixed_1'), ('inFile', 'inFile'), ('A', 'a'), ('_x', '_x'), ('no name', 'no name'), ('ABC__D_', 'abcD')) t(raw, folded)""")
def relation_fold(g: Graph) -> DataFrame:
    rows = g.spark.createDataFrame([(n,) for n in ("HAS_FACT", "Mixed_1", "inFile", "A", "_x", "no name", "ABC__D_")], "raw string")
    return rows.select("raw", P.fold_relation(F.col("raw")).alias("folded"))


@query("SELECT hid, props['part'] AS part, '9' AS line, 'x=' AS k FROM edges WHERE relation = 'ships'")
def attrs_view(g: Graph) -> DataFrame:
    """Pairs in one text as a map, overlaid by real properties."""
    text = F.concat(F.lit("note;part=0;k=x=;line=1;line="), F.lit("9"))
    rows = g.edges.where("relation = 'ships'").select("hid", T.attributes(text).alias("attrs"), F.map_filter("props", lambda k, v: k == "part").alias("real"))
    return _props(rows.select("hid", P.overlaid("attrs", "real").alias("props")), "part", "line", "k")


@query("SELECT hid, 'PRT_' || trim(regexp_replace(props['name'] || ' / ' || props['brand'], '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug FROM nodes WHERE tag = 'PRT'")
def locator_slug(g: Graph) -> DataFrame:
    return g.nodes.where("tag = 'PRT'").select("hid", T.slug("PRT", F.concat(P.value("name"), F.lit(" / "), P.value("brand"))).alias("slug"))


@query("""
SELECT hid, '(:' || tag || ' {id: ''' || hid || ''', acctbal: ' || props['acctbal'] || ', name: ''' || props['name'] || '''' || CASE WHEN tag = 'CUS' THEN ', segment: ''' || props['segment'] || '''' ELSE '' END || '})' AS line FROM nodes WHERE tag IN ('CUS', 'SUP')""")
def emit_nodes(g: Graph) -> DataFrame:
    """Customers and suppliers as shaped lines."""
    return emit.node_lines(Graph(g.nodes.where("tag in ('CUS', 'SUP')"), g.edges, g.limits))


@query("""
SELECT hid, '(:SUP {id: ''' || src || '''})-[:ships {line: ' || props['line'] || ', part: ' || props['part'] || '}]->(:ORD {id: ''' || dist || '''})' AS line FROM edges WHERE relation = 'ships'""")
def emit_edges(g: Graph) -> DataFrame:
    return emit.edge_lines(g, g.edges.where("relation = 'ships'"))


@query("""
SELECT '@CUS: ' || hid || '|' || hid || '|' || props['acctbal'] || '|' || replace(props['name'], '|', '\\|') || '|' || props['segment'] AS line FROM nodes WHERE tag = 'CUS' UNION ALL
SELECT '@EDG: |' || hid || '|' || src || '|' || relation || '|' || dist FROM edges WHERE relation = 'placed' UNION ALL SELECT '@REL: placed' UNION ALL SELECT '# graph-snapshot-v1' UNION ALL SELECT '@SNAP: 2|s|0'
UNION ALL SELECT 'SCHEMA CUS ; fields=id hid acctbal name segment' UNION ALL SELECT 'SCHEMA EDG ; fields=id hid src relation dist'""")
def snapshot_lines(g: Graph) -> DataFrame:
    """Customers and their orders' edges as a snapshot in text."""
    return emit.snapshot_lines(Graph(g.nodes.where("tag = 'CUS'"), g.edges.where("relation = 'placed'"), g.limits), "s").select("line")


@query("""
SELECT c.hid AS seed, 1::INT AS row, c.hid || ' -' || e.hid || '-> ' || e.dist AS line FROM nodes c JOIN edges e ON e.src = c.hid AND e.relation = 'partOf' WHERE c.tag = 'SUP'""")
def walk_lines(g: Graph) -> DataFrame:
    return emit.walk_lines(walks.typed_walk(g, walks.seeds_of(g, g.nodes.where("tag = 'SUP'")), "partOf"))


@query()
def walk_handles(g: Graph) -> DataFrame:
    """Opaque handles of all customers, by a keyed hash in built-in functions."""
    return seeds.handles(g.nodes.where("tag = 'CUS'"), "session").select("hid", "handle")


# Texts as graphs


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """Program texts, one per part: a module with functions and a class; every second one calls the first function once more."""
    parts = spark.read.parquet(f"{folder}/part.parquet")
    key = F.col("p_partkey").cast("string")
    last = F.when(F.col("p_partkey") % 2 == 0, "    return first(1, 2)\n").otherwise("    return 0\n")
    text = F.concat(F.lit("import os\n\n\ndef first(a, b):\n    return a\n\n\nclass Box:\n    def open(self):\n        return first(1, 2)\n\n\ndef part_"), key, F.lit("():\n"), last)
    return parts.select(F.concat(F.lit("m"), key, F.lit(".py")).alias("path"), text.alias("text"))


@query("""
WITH p AS (SELECT p_partkey AS k, 'm' || p_partkey || '_py' AS m FROM part)
SELECT 'defines' AS relation, 'MOD_' || m AS src, 'SYM_' || m || '_' || unnest(['first', 'Box', 'Box_open', 'part_' || k]) AS dist FROM p UNION ALL SELECT 'owns', 'SYM_' || m || '_Box', 'SYM_' || m || '_Box_open' FROM p
UNION ALL SELECT 'calls', 'SYM_' || m || '_Box_open', 'SYM_' || m || '_first' FROM p UNION ALL SELECT 'calls', 'SYM_' || m || '_part_' || k, 'SYM_' || m || '_first' FROM p WHERE k % 2 = 0""", graph=False)
def ingest_code(spark: SparkSession, folder: str) -> DataFrame:
    """Relations found in program texts."""
    return artefacts.code(_sources(spark, folder)).edges.select("relation", "src", "dist")


@query("""
WITH c AS (SELECT 'c' || p_partkey || '_ato' AS c, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['r1', 'r2'] ELSE ['r1'] END) AS r FROM part)
SELECT 'owns' AS relation, 'CMP_' || c || '_' || r AS src, 'PIN_' || c || '_' || r || '_' || unnest(['1', '2']) AS dist FROM c
UNION ALL SELECT 'on_net', 'PIN_' || c || '_' || r || '_1', 'NET_' || c || '_gnd' FROM c UNION ALL SELECT 'on_net', 'PIN_' || c || '_' || r || '_2', 'NET_' || c || '_vcc' FROM c""", graph=False)
def ingest_circuit(spark: SparkSession, folder: str) -> DataFrame:
    """Components, nets and pins found in circuit texts, one per part, with one component or two."""
    parts = spark.read.parquet(f"{folder}/part.parquet")
    more = F.when(F.col("p_partkey") % 2 == 0, "    r2 = new Res\n    gnd ~ r2.1\n    r2.2 ~ vcc\n").otherwise("")
    text = F.concat(F.lit("component Res:\n    pin 1\n    pin 2\n\nmodule Main:\n    signal gnd\n    signal vcc\n    r1 = new Res\n    r1.1 ~ gnd\n    vcc ~ r1.2  # a tie\n"), more)
    made = artefacts.circuit(parts.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit(".ato")).alias("path"), text.alias("text")))
    return made.edges.select("relation", "src", "dist")


@query("""
WITH s AS (SELECT s_suppkey AS k, 'P' || s_suppkey AS p FROM supplier)
SELECT 'contains' AS relation, 'PKG_' || p AS src, unnest(['PRT_' || p || '_Base', 'PRT_' || p || '_unit', 'REQ_' || p || '_R'] || CASE WHEN k % 2 = 0 THEN ['PRT_' || p || '_Extra'] ELSE [] END) AS dist FROM s
UNION ALL SELECT 'typedBy', 'PRT_' || p || '_unit', 'PRT_' || p || '_Base' FROM s UNION ALL SELECT 'satisfies', 'PRT_' || p || '_unit', 'REQ_' || p || '_R' FROM s""", graph=False)
def ingest_sysml(spark: SparkSession, folder: str) -> DataFrame:
    """Relations found in model texts, one per supplier; every second one has a part more."""
    key = F.col("s_suppkey").cast("string")
    more = F.when(F.col("s_suppkey") % 2 == 0, "  part def Extra;\n").otherwise("")
    text = F.concat(F.lit("package P"), key, F.lit(" {\n  part def Base;\n"), more, F.lit("  part unit : Base { satisfy P"), key, F.lit("::R; }\n  requirement def R { }\n}\n"))
    made = artefacts.sysml(spark.read.parquet(f"{folder}/supplier.parquet").select(F.concat(F.lit("s"), key, F.lit(".sysml")).alias("path"), text.alias("text")))
    return made.edges.select("relation", "src", "dist")


@query("""
SELECT 'RUL_rule_' || s_suppkey AS src, 'SKL_skill_' || s_suppkey AS dist, 'governs' AS relation FROM supplier""", graph=False)
def ingest_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between skills and rules by their front matter, two files per supplier."""
    s = spark.read.parquet(f"{folder}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    skill = s.select(F.concat(F.lit("skill "), key, F.lit("/SKILL.md")).alias("path"), F.lit("---\ndescription: does   things\n---\n").alias("text"))
    rule = s.select(F.concat(F.lit("r"), key, F.lit(".mdc")).alias("path"), F.concat(F.lit("---\nname: rule "), key, F.lit("\ngoverns: [Skill "), key, F.lit("]\n---\n")).alias("text"))
    return artefacts.skills(skill.union(rule)).edges.select("src", "dist", "relation")


# Sessions


@query("""
WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""", graph=False)
def ttl_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that every event of a user prolongs by two hours."""
    return live.activity(spark.read.parquet(f"{folder}/events.parquet"), "2 hours")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL", graph=False)
def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    return live.windowed(spark.read.parquet(f"{folder}/events.parquet"), "1 day")


@query("""
SELECT 'USR_' || user_id AS hid, max(event_id) AS version, arg_max(event_type, event_id) AS tag FROM events GROUP BY user_id""", graph=False)
def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every row of a log of changes."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    log = events.select(F.concat(F.lit("USR_"), F.col("user_id").cast("string")).alias("hid"), F.col("event_id").alias("version"), F.lit(False).alias("deleted"), F.col("event_type").alias("tag"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("props"))
    return live.latest(log).select("hid", "version", "tag")
