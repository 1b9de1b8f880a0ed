"""More registered queries: answers as text, files and back, row writes, marks and leases; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props as P
from ..functions import text as T
from ..model import Graph, Limits, nickname
from ..operators import census, changes, emit, govern, pinmap, seeds, walks
from ..sources import stored
from ..storage import fresh_path
from .catalogue import BROKEN, ORACLE_SQL, RHO, _broken, _map, _props, query

#: A node as a shaped line, without its nickname.
LINE = """'(:' || tag || ' {' || list_aggregate(list_transform(list_filter(pairs, lambda p: p.value <> '' AND NOT (p.key = 'recycle' AND p.value = 'persistent')),
lambda p: p.key || ': ' || CASE WHEN regexp_full_match(p.value, 'true|false|-?\\d+|-?\\d+\\.\\d+') THEN p.value ELSE '''' || p.value || '''' END), 'string_agg', ', ') || '})'"""
_NUMBER_SQL = "regexp_extract(hid, '\\d+$')::BIGINT"


def _number() -> Column:
    """The number at the end of a handle."""
    return F.regexp_extract("hid", r"\d+$", 0).cast("long")


def _places(g: Graph, *tags: str) -> Graph:
    return Graph(g.nodes.where(F.col("tag").isin(*tags)), g.edges.where("relation = 'partOf'"), g.limits)


# Answers as text


@query(RHO + """
, lined AS (SELECT *, """ + LINE + """ AS line FROM ranked),
cues AS (SELECT 'n:' || hid AS cue, 'NAT' AS tag, 'name' AS key, props['name'] AS value FROM nodes WHERE tag = 'NAT' UNION ALL SELECT DISTINCT 's:' || props['segment'], 'CUS', 'segment', props['segment'] FROM nodes WHERE tag = 'CUS' UNION ALL SELECT 'miss', 'REG', 'name', 'Nowhere'),
hit AS (SELECT c.cue, n.hid, n.tag, n.pairs, n.line FROM cues c JOIN lined n ON n.tag = c.tag AND n.props[c.key] = c.value),
counted AS (SELECT c.cue, count(h.hid) AS n FROM cues c LEFT JOIN hit h ON h.cue = c.cue GROUP BY c.cue),
peak AS (SELECT r.hid, r.rho FROM rho r WHERE r.rho >= (SELECT coalesce(max(q.rho), 0) FROM s JOIN rho q ON q.hid = s.far WHERE s.node = r.hid AND s.far <> r.hid)),
best AS (SELECT l.*, p.rho FROM peak p JOIN lined l ON l.hid = p.hid ORDER BY p.rho DESC, l.tag, l.pairs, l.hid LIMIT 4),
ends AS (SELECT e.hid, e.src, e.dist, a.tag AS ta, a.pairs AS ap, b.tag AS bt, b.pairs AS bp, a.line || '-[:partOf]->' || b.line AS line FROM edges e JOIN lined a ON a.hid = e.src JOIN lined b ON b.hid = e.dist WHERE e.relation = 'partOf'),
packed AS (SELECT h.cue, 0 AS part, h.tag, '' AS ta, h.pairs[1:0] AS ap, '' AS bt, h.pairs[1:0] AS bp, h.pairs, h.hid, h.line FROM hit h JOIN counted c ON c.cue = h.cue AND c.n = 1
UNION ALL SELECT h.cue, 1, n.tag, '', n.pairs[1:0], '', n.pairs[1:0], n.pairs, n.hid, n.line FROM hit h JOIN counted c ON c.cue = h.cue AND c.n = 1 JOIN ends e ON e.src = h.hid OR e.dist = h.hid JOIN lined n ON n.hid = CASE WHEN e.src = h.hid THEN e.dist ELSE e.src END
UNION ALL SELECT h.cue, 2, 'EDG', e.ta, e.ap, e.bt, e.bp, e.ap[1:0], e.hid, e.line FROM hit h JOIN counted c ON c.cue = h.cue AND c.n = 1 JOIN ends e ON e.src = h.hid OR e.dist = h.hid),
placed AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY part, tag, ta, ap, bt, bp, pairs, hid) AS k, count(*) OVER (PARTITION BY cue) AS offered FROM packed),
told AS (SELECT cue, 0 AS section, 0 AS k, '## CueConflict |Q|=' || n AS line FROM counted WHERE n > 1
UNION ALL SELECT cue, 3, k, line FROM (SELECT h.cue, h.line, row_number() OVER (PARTITION BY h.cue ORDER BY h.tag, h.pairs, h.hid) AS k FROM hit h JOIN counted c ON c.cue = h.cue AND c.n > 1) WHERE k <= 4
UNION ALL SELECT cue, 0, 0, '## CueMiss MATCH_L=0' FROM counted WHERE n = 0
UNION ALL SELECT cue, 1, 0, '## Peak_L |Q|=' || (SELECT count(*) FROM peak) FROM counted WHERE n = 0
UNION ALL SELECT c.cue, 3, row_number() OVER (PARTITION BY c.cue ORDER BY b.tag, b.pairs, b.hid), b.line FROM counted c, best b WHERE c.n = 0
UNION ALL SELECT DISTINCT cue, 2, 0, '## Truncation truncated=true M=4 omitted=' || (offered - 4) || ' reason=max_rows' FROM placed WHERE offered > 4
UNION ALL SELECT cue, 4, k, line FROM placed WHERE k <= 4)
SELECT cue, row_number() OVER (PARTITION BY cue ORDER BY section, k, line) AS position, line FROM told""")
def pin_map_text(g: Graph) -> DataFrame:
    """Answers to cues: nations by name, segments that many customers share, and a region that is not there."""
    nations = g.nodes.where("tag = 'NAT'").select(F.concat(F.lit("n:"), "hid").alias("cue"), F.lit("nat").alias("tag"), F.lit("name").alias("key"), P.value("name").alias("value"))
    segments = g.nodes.where("tag = 'CUS'").select(P.value("segment").alias("value")).distinct().select(F.concat(F.lit("s:"), "value").alias("cue"), F.lit("CUS").alias("tag"), F.lit("segment").alias("key"), "value")
    none = g.spark.createDataFrame([("miss", "REG", "name", "Nowhere")], "cue string, tag string, key string, value string")
    return pinmap.compose(g, nations.union(segments).union(none), depth=1, max_rows=4)


@query("SELECT row_number() OVER (ORDER BY tag, pairs, hid) AS position, hid, tag, props['name'] AS name FROM ranked WHERE tag IN ('CUS', 'NAT') QUALIFY position <= 48")
def slice_summary(g: Graph) -> DataFrame:
    """The first rows of a slice in brief."""
    return pinmap.summary(g.nodes.where("tag in ('CUS', 'NAT')")).select("position", "hid", "tag", F.col("fields")["name"].alias("name"))


@query(RHO + """ , p AS (SELECT r.hid, r.rho FROM rho r WHERE r.rho >= (SELECT coalesce(max(q.rho), 0) FROM s JOIN rho q ON q.hid = s.far WHERE s.node = r.hid AND s.far <> r.hid))
SELECT p.hid, p.rho FROM p JOIN ranked n ON n.hid = p.hid ORDER BY p.rho DESC, n.tag, n.pairs, n.hid LIMIT 10""")
def top_peaks(g: Graph) -> DataFrame:
    """The ten peaks with the most edges."""
    return census.top_peaks(g, 10)


@query("""
, o AS (SELECT e.*, row_number() OVER (PARTITION BY src ORDER BY relation, n.tag, n.pairs, list_sort(map_entries(e.props)), e.hid) AS k FROM edges e JOIN ranked n ON n.hid = e.dist WHERE src LIKE 'SUP%'),
f AS (SELECT dist AS node FROM o WHERE k <= 5 UNION SELECT src FROM edges WHERE dist LIKE 'SUP%' UNION SELECT hid FROM nodes WHERE tag = 'SUP')
SELECT 'fanout' AS reason, src AS at, count(*) AS offered, 5::BIGINT AS kept FROM edges WHERE src IN (SELECT node FROM f) GROUP BY src HAVING count(*) > 5 UNION ALL SELECT 'depth', NULL, 9, 4""")
def clip_notes(g: Graph) -> DataFrame:
    """Where depth and fan-out cut a walk from the suppliers."""
    reached = walks.neighbours(g, walks.seeds_of(g, g.nodes.where("tag = 'SUP'")), 1, fanout=5, path=False)
    return walks.clip_notes(g, reached, 9, fanout=5)


@query("""
, l AS (SELECT row_number() OVER (ORDER BY hid) AS position, '(:NAT {id: ''' || hid || ''', name: ''' || props['name'] || '''})' AS line FROM nodes WHERE tag = 'NAT')
SELECT position, line FROM l QUALIFY sum(strlen(line) + 1) OVER (ORDER BY position) <= 500""")
def reply_clipped(g: Graph) -> DataFrame:
    """Lines of nations until five hundred bytes are full."""
    lines = emit.node_lines(_places(g, "NAT"))
    order = F.row_number().over(Window.orderBy("hid"))  # twenty-five rows
    return emit.clipped(lines.withColumn("position", order), 500).select("position", "line")


@query(BROKEN + """, c AS (SELECT (SELECT count(*) FROM live) + (SELECT count(*) FROM edges) AS rows, (SELECT count(*) FROM live WHERE props['recycle'] IN ('delete_on_settle', 'delete_on_expire')) AS recyclable, (SELECT count(*) FROM dang) AS dangling, (SELECT count(*) FROM orph) AS orphans)
SELECT unnest(['near_cap|rows|' || rows || '/100', 'stale|recyclable|' || recyclable, 'stale|dangling|' || dangling] || CASE WHEN orphans > 0 THEN ['stale|orphans|' || orphans] ELSE [] END) AS warning FROM c""")
def health_warnings(g: Graph) -> DataFrame:
    """What a session is warned of: a limit that is passed, and what is stale."""
    broken = _broken(g)
    return census.health(Graph(broken.nodes, broken.edges, Limits(graph_rows=100)))


# Files and back


@query("SELECT hid, props['name'] || '|' || props['segment'] || '\\' AS name, props['segment'] AS segment FROM nodes WHERE tag = 'CUS'")
def pipe_lines_read(g: Graph) -> DataFrame:
    """Customers as lines between bars, with bars and backslashes in their names, read back."""
    named = _map("id", nickname(), "name", F.concat(P.value("name"), F.lit("|"), P.value("segment"), F.lit("\\")), "segment", P.value("segment"))
    schema = {"CUS": ["id", "name", "segment"]}
    lines = emit.pipe_lines(g.nodes.where("tag = 'CUS'").select("hid", "tag", named.alias("props")), schema)
    back = stored.from_lines(lines.select(F.col("line").alias("value")), schema)
    return _props(back.nodes.select("hid", "props"), "name", "segment")


_SMALL = "SELECT hid, tag AS kind, props['name'] AS a, '' AS b FROM nodes WHERE tag IN ('CUS', 'NAT', 'REG') UNION ALL SELECT hid, relation, src, dist FROM edges WHERE relation = 'partOf' AND src NOT LIKE 'SUP%'"


def _small(g: Graph) -> Graph:
    return Graph(g.nodes.where("tag in ('CUS', 'NAT', 'REG')"), g.edges.where("relation = 'partOf' and src not like 'SUP%'"), g.limits)


def _rows(g: Graph) -> DataFrame:
    nodes = g.nodes.select("hid", F.col("tag").alias("kind"), P.value("name").alias("a"), F.lit("").alias("b"))
    return nodes.union(g.edges.select("hid", "relation", "src", "dist"))


@query(_SMALL)
def snapshot_round_trip(g: Graph) -> DataFrame:
    """A snapshot in text written and read back."""
    path = fresh_path(g.spark, "snapshot")
    emit.write_snapshot(_small(g), path, "s")
    return _rows(stored.read_snapshot(g.spark, path))


@query(_SMALL)
def version_round_trip(g: Graph) -> DataFrame:
    """A version saved as Parquet and loaded."""
    path = fresh_path(g.spark, "versions")
    emit.save(_small(g), path)
    return _rows(stored.load(g.spark, path, 0))


@query("SELECT hid AS a, '' AS relation, props['name'] AS b FROM nodes WHERE tag IN ('CUS', 'NAT', 'REG') UNION ALL SELECT src, relation, dist FROM edges WHERE relation = 'partOf' AND src NOT LIKE 'SUP%'")
def jsonl_round_trip(g: Graph) -> DataFrame:
    """JSON lines written and read back; edges find their ends by nickname."""
    path = fresh_path(g.spark, "jsonl")
    emit.write_jsonl(_small(g), path)
    back = stored.read_jsonl(g.spark, path)
    return back.nodes.select(F.col("hid").alias("a"), F.lit("").alias("relation"), P.value("name").alias("b")).union(back.edges.select("src", "relation", "dist"))


@query("""
SELECT 'CREATE (:NAT {id: ''' || hid || ''', name: ''' || props['name'] || '''})' AS line FROM nodes WHERE tag = 'NAT' UNION ALL
SELECT 'MATCH (a:NAT {id: ''' || src || '''}), (b:REG {id: ''' || dist || '''}) CREATE (a)-[:partOf]->(b)' FROM edges WHERE relation = 'partOf' AND src LIKE 'NAT%'""")
def create_statements(g: Graph) -> DataFrame:
    """Nations and their places as statements that would make them."""
    part = Graph(g.nodes.where("tag = 'NAT'"), g.edges, g.limits)
    whole = Graph(g.nodes, g.edges.where("relation = 'partOf' and src like 'NAT%'"), g.limits)
    return emit.create_lines(part, part.edges.where(F.lit(False))).select("line").union(emit.create_lines(whole).where("part = 1").select("line"))


@query("""
SELECT DISTINCT tag, key FROM (SELECT tag, unnest(map_keys(props)) AS key FROM nodes UNION ALL SELECT 'EDG', unnest(list_concat(map_keys(props), ['src', 'dist', 'relation'])) FROM edges)
WHERE NOT (tag IN ('CUS', 'NAT') AND key IN ('id', 'name')) AND NOT (tag = 'EDG' AND key IN ('src', 'dist', 'line'))""")
def undeclared_fields(g: Graph) -> DataFrame:
    """Properties in use that a schema does not name."""
    return census.undeclared(g, {"CUS": ["id", "name"], "NAT": ["id", "name"], "EDG": ["src", "dist", "line"]})


# Rows written by handle


@query(f"SELECT hid, CASE WHEN {_NUMBER_SQL} % 2 = 0 THEN 'PUT' ELSE props['segment'] END AS segment, props['name'] AS name FROM nodes WHERE tag = 'CUS' UNION ALL SELECT 'CUS_new', 'PUT', 'fresh'")
def put_upsert(g: Graph) -> DataFrame:
    """Every second customer set, and one added, by handle; an empty text clears nothing."""
    even = g.nodes.where("tag = 'CUS'").where(_number() % 2 == 0).select("hid", F.lit("cus").alias("tag"), _map("segment", "PUT", "name", "").alias("props"))
    new = g.spark.createDataFrame([("CUS_new", "CUS", {"segment": "PUT", "name": "fresh"})], "hid string, tag string, props map<string,string>")
    return _props(changes.put(g, even.union(new)).nodes.where("tag = 'CUS'").select("hid", "props"), "segment", "name")


@query(f"SELECT hid, CASE WHEN {_NUMBER_SQL} < 50 THEN 'only' ELSE props['segment'] END AS segment, CASE WHEN {_NUMBER_SQL} < 50 THEN '' ELSE props['name'] END AS name FROM nodes WHERE tag = 'CUS'")
def put_replace(g: Graph) -> DataFrame:
    """Customers below fifty with nothing but a segment."""
    rows = g.nodes.where("tag = 'CUS'").where(_number() < 50).select("hid", "tag", _map("segment", "only").alias("props"))
    return _props(changes.put(g, rows, "replace").nodes.where("tag = 'CUS'").select("hid", "props"), "segment", "name")


@query(BROKEN + " SELECT hid, relation, src, dist FROM dang")
def rows_deleted(g: Graph) -> DataFrame:
    """What dangles once every tenth customer is removed by handle."""
    gone = g.nodes.where("tag = 'CUS'").where(_number() % 10 == 0)
    return census.dangling(changes.delete_rows(g, gone)).select("hid", "relation", "src", "dist")


@query("SELECT hid, props['name'] AS name FROM nodes WHERE tag = 'CUS' AND props['segment'] = 'BUILDING' UNION ALL SELECT 'new:' || hid, 'soon ' || props['name'] FROM nodes WHERE tag = 'NAT'")
def pending_match(g: Graph) -> DataFrame:
    """A pattern over nodes and over rows that are not written yet."""
    pending = g.nodes.where("tag = 'NAT'").select(F.concat(F.lit("new:"), "hid").alias("hid"), F.lit("CUS").alias("tag"), _map("segment", "BUILDING", "name", F.concat(F.lit("soon "), P.value("name"))).alias("props"))
    return _props(seeds.match_nodes(g, "CUS", {"segment": "BUILDING"}, pending).select("hid", "props"), "name")


@query("SELECT n AS name, EXISTS (SELECT 1 FROM edges WHERE relation = f) AS present FROM (VALUES ('PART_OF', 'partOf'), ('placed', 'placed'), ('nothing', 'nothing'), ('SuppliedBy', 'suppliedBy')) t(n, f)")
def relation_probe(g: Graph) -> DataFrame:
    """Whether relations are there at all."""
    return g.spark.createDataFrame([(n, seeds.has_relation(g, n)) for n in ("PART_OF", "placed", "nothing", "SuppliedBy")], "name string, present boolean")


# Walks


@query("""
, w AS (SELECT c.hid AS src, e.dist AS n, [e.hid] AS path FROM nodes c JOIN edges e ON e.src = c.hid AND e.relation = 'partOf' WHERE c.tag = 'SUP')
SELECT src AS seed, 1 AS hop, src AS parent, n AS far, path[1] AS path FROM w UNION ALL SELECT w.src, 2, w.n, f.dist, w.path[1] || ',' || f.hid FROM w JOIN edges f ON f.src = w.n AND f.relation = 'partOf'""")
def walk_paths(g: Graph) -> DataFrame:
    """Suppliers' ways to nation and region, edge by edge, with the node before the last."""
    found = walks.typed_walk(g, walks.seeds_of(g, g.nodes.where("tag = 'SUP'")), "partOf", "out", 1, 2)
    return found.select("seed", "hop", "parent", "far", F.array_join(F.transform("path", lambda s: s["edge"]), ",").alias("path"))


@query("""
, q AS (SELECT 'CUS_' || c_custkey AS src, 'REG_' || (c_custkey % 5) AS dist FROM customer),
near AS (SELECT q.src, q.dist, 2 AS hops, e.hid || ',' || f.hid AS edges FROM q JOIN edges e ON e.src = q.src AND e.relation = 'partOf' JOIN edges f ON f.src = e.dist AND f.dist = q.dist AND f.relation = 'partOf'),
sup AS (SELECT e.src AS s, f.dist AS r, e.hid || ',' || f.hid AS tail FROM edges e JOIN edges f ON f.src = e.dist AND f.relation = 'partOf' WHERE e.relation = 'partOf' AND e.src LIKE 'SUP%'),
prt AS (SELECT b.src AS p, sup.r, min([b.hid, sup.tail]) AS tail FROM edges b JOIN sup ON sup.s = b.dist WHERE b.relation = 'suppliedBy' GROUP BY ALL),
ord AS (SELECT a.src AS o, prt.r, min(list_prepend(a.hid, prt.tail)) AS tail FROM edges a JOIN prt ON prt.p = a.dist WHERE a.relation = 'contains' GROUP BY ALL),
far AS (SELECT q.src, q.dist, 5 AS hops, min(list_prepend(p.hid, ord.tail)) AS path FROM q JOIN edges p ON p.src = q.src AND p.relation = 'placed' JOIN ord ON ord.o = p.dist AND ord.r = q.dist GROUP BY ALL)
SELECT q.src, q.dist, coalesce(near.hops, far.hops) AS hops, coalesce(near.edges, array_to_string(far.path, ',')) AS edges
FROM q LEFT JOIN near ON near.src = q.src AND near.dist = q.dist LEFT JOIN far ON far.src = q.src AND far.dist = q.dist""")
def find_path_whole(g: Graph) -> DataFrame:
    """The shortest way from each customer to one region over all edges of the graph, five at most."""
    pairs = g.nodes.where("tag = 'CUS'").select(F.col("hid").alias("src"), F.concat(F.lit("REG_"), (_number() % 5).cast("string")).alias("dist"))
    return walks.find_paths(g, pairs).select("src", "dist", "hops", F.array_join(F.transform("path", lambda s: s["edge"]), ",").alias("edges"))


ORACLE_SQL["shell_cap"] = ORACLE_SQL["orphans"].split(BROKEN)[0] + """
, under AS (SELECT 'REG_' || n_regionkey AS pack, 'NAT_' || n_nationkey AS hid, 'NAT_' || n_nationkey AS nat FROM nation),
low AS (SELECT u.pack, e.src AS hid FROM under u JOIN edges e ON e.dist = u.nat AND e.relation = 'partOf'),
link AS (SELECT u.pack, e.hid, e.src, e.dist FROM under u JOIN edges e ON e.relation = 'partOf' AND (e.src = u.nat OR e.dist = u.nat)),
p AS (SELECT hid AS pack, 0 AS part, hid, tag, '' AS ta, pairs[1:0] AS ap, '' AS bt, pairs[1:0] AS bp, pairs, NULL::VARCHAR AS src, NULL::VARCHAR AS dist FROM ranked WHERE tag = 'REG'
UNION ALL SELECT x.pack, 1, n.hid, n.tag, '', n.pairs[1:0], '', n.pairs[1:0], n.pairs, NULL, NULL FROM (SELECT pack, hid FROM under UNION ALL SELECT pack, hid FROM low) x JOIN ranked n ON n.hid = x.hid
UNION ALL SELECT l.pack, 2, l.hid, 'EDG', a.tag, a.pairs, b.tag, b.pairs, a.pairs[1:0], l.src, l.dist FROM link l JOIN ranked a ON a.hid = l.src JOIN ranked b ON b.hid = l.dist),
q AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY part, tag, ta, ap, bt, bp, pairs, hid) AS position FROM p QUALIFY position <= 50),
n AS (SELECT * FROM q WHERE part < 2 QUALIFY row_number() OVER (PARTITION BY pack ORDER BY position) <= 8),
e AS (SELECT * FROM q WHERE part = 2 QUALIFY row_number() OVER (PARTITION BY pack ORDER BY ((pack, src) IN (SELECT (pack, hid) FROM n))::INT + ((pack, dist) IN (SELECT (pack, hid) FROM n))::INT DESC, position) <= 12)
SELECT pack, position, CASE part WHEN 0 THEN 'seed' WHEN 1 THEN 'node' ELSE 'edge' END AS part, hid, tag FROM (SELECT * FROM n UNION ALL SELECT * FROM e)"""

#: A keyed hash and base 32 in SQL: blocks of the key with both pads, then five bits a digit.
_HANDLE = """, m AS (SELECT hid, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || ('{kind}:' || hid)::BLOB))) AS mac FROM {rows})
SELECT hid, 'h_' || list_aggregate(list_transform(range(26), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', (((('0x' || substr(mac, (i * 5 // 4 + 1)::INT, 2))::INT) // [8, 4, 2, 1][(i % 4 + 1)::INT]) % 32 + 1)::INT, 1)), 'string_agg', '') AS handle FROM m"""


def _handle_sql(rows: str, kind: str, secret: bytes = b"session") -> str:
    key = secret.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return ORACLE_SQL["orphans"].split(BROKEN)[0] + _HANDLE.format(outer=outer, inner=inner, kind=kind, rows=rows)


ORACLE_SQL["walk_handles"] = _handle_sql("nodes WHERE tag = 'CUS'", "node")


@query()
def edge_handles(g: Graph) -> DataFrame:
    """Opaque handles of the edges between places."""
    return seeds.handles(g.edges.where("relation = 'partOf'"), "session", "edge").select("hid", "handle")


ORACLE_SQL["edge_handles"] = _handle_sql("edges WHERE relation = 'partOf'", "edge")


# Leases


@query("SELECT 'ann' AS holder, 'NAT_3' AS anchor, '2024-01-15 00:02:00' AS until, hid FROM (SELECT src AS hid FROM edges WHERE relation = 'partOf' AND dist = 'NAT_3' UNION SELECT dist FROM edges WHERE relation = 'partOf' AND src = 'NAT_3' UNION SELECT 'NAT_3')")
def reserve_rows(g: Graph) -> DataFrame:
    """The rows that a lease on a nation's neighbourhood covers."""
    none = g.spark.createDataFrame([], govern.LEASES)
    held = govern.reserve(Graph(g.nodes, g.edges.where("relation = 'partOf'"), g.limits), none, "NAT_3", "ann", "2024-01-15 00:00:00", 120, depth=1)
    return held.select("holder", "anchor", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "hid")


@query("""
SELECT DISTINCT 'r' || c_nationkey AS rid, 'NAT_' || c_nationkey AS anchor, CASE WHEN c_nationkey % 2 = 0 THEN 'ann' ELSE 'bob' END AS holder FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey <> 3""")
def reserves_touching(g: Graph) -> DataFrame:
    """Leases that cover customers with orders, of those that still run."""
    nation = F.regexp_extract("dist", r"\d+$", 0).cast("long")
    own = g.edges.where("relation = 'partOf' and src like 'CUS%'")
    leases = own.select(F.concat(F.lit("r"), nation.cast("string")).alias("rid"), F.when(nation % 2 == 0, "ann").otherwise("bob").alias("holder"), F.col("dist").alias("anchor"), F.when(nation == 3, F.lit("2024-01-01")).otherwise(F.lit("2024-02-01")).cast("timestamp").alias("until"), F.col("src").alias("hid"))
    return govern.touching(leases, g.edges.where("relation = 'placed'").select(F.col("src").alias("hid")), "2024-01-15 00:00:00").select("rid", "anchor", "holder")


# Scalars


@query("SELECT hid, 'sn_cus_' || substr(sha256('seed ' || hid), 1, 16) AS nick FROM nodes WHERE tag = 'CUS'")
def leftover_nicks(g: Graph) -> DataFrame:
    return g.nodes.where("tag = 'CUS'").select("hid", T.leftover_nick(F.col("tag"), F.concat(F.lit("seed "), "hid")).alias("nick"))


@query("""
SELECT hid, CASE WHEN length(f) > 20 THEN rtrim(substr(f, 1, 19)) || '…' ELSE f END AS phrase FROM (SELECT hid, trim(regexp_replace('  ' || props['name'] || E'\\t \\n' || props['brand'], '\\s+', ' ', 'g')) AS f FROM nodes WHERE tag = 'PRT')""")
def phrase_cut(g: Graph) -> DataFrame:
    text = F.concat(F.lit("  "), P.value("name"), F.lit("\t \n"), P.value("brand"))
    return g.nodes.where("tag = 'PRT'").select("hid", T.phrase(text, 20).alias("phrase"))


@query("""
SELECT hid, CASE WHEN k % 3 = 0 THEN props['size'] WHEN k % 3 = 1 THEN props['retailprice'] ELSE '''' || replace(replace(props['name'] || '''s \\', '\\', '\\\\'), '''', '\\''') || '\\n''' END AS written,
CASE WHEN k % 3 = 0 THEN props['size'] WHEN k % 3 = 1 THEN props['retailprice'] ELSE props['name'] || '''s \\' || chr(10) END AS back FROM (SELECT *, regexp_extract(hid, '\\d+$')::BIGINT AS k FROM nodes WHERE tag = 'PRT')""")
def literal_forms(g: Graph) -> DataFrame:
    """Values as they are written, numbers bare and texts quoted, and read back."""
    text = F.when(_number() % 3 == 0, P.value("size")).when(_number() % 3 == 1, P.value("retailprice")).otherwise(F.concat(P.value("name"), F.lit("'s \\\n")))
    rows = g.nodes.where("tag = 'PRT'").select("hid", T.literal(text).alias("written"))
    return rows.select("hid", "written", F.when(F.startswith("written", F.lit("'")), T.unquoted(F.col("written"))).otherwise(F.col("written")).alias("back"))


@query("""
SELECT hid, CASE WHEN k % 4 = 0 THEN '{"k":' || props['size'] || ',"n":["' || props['brand'] || '",null]}' WHEN k % 4 = 1 THEN props['brand'] WHEN k % 4 = 2 THEN '' ELSE 'true' END AS stored FROM (SELECT *, regexp_extract(hid, '\\d+$')::BIGINT AS k FROM nodes WHERE tag = 'PRT')""")
def canonical_values(g: Graph) -> DataFrame:
    """JSON values as the texts that are stored."""
    whole = F.concat(F.lit('{ "k" : '), P.value("size"), F.lit(', "n": [ "'), P.value("brand"), F.lit('", null ] }'))
    json = F.when(_number() % 4 == 0, whole).when(_number() % 4 == 1, F.concat(F.lit('"'), P.value("brand"), F.lit('"'))).when(_number() % 4 == 2, F.lit("null")).otherwise(F.lit(" true "))
    return g.nodes.where("tag = 'PRT'").select("hid", T.canonical(json).alias("stored"))


@query("SELECT hid, replace('session CUS_1 asks for ' || hid, 'CUS_1', '<session>') AS message FROM nodes WHERE tag = 'CUS'")
def redacted_messages(g: Graph) -> DataFrame:
    return g.nodes.where("tag = 'CUS'").select("hid", T.without_secret(F.concat(F.lit("session CUS_1 asks for "), "hid"), "CUS_1").alias("message"))
