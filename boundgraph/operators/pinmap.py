"""Cues answered as text: what they name, what is around it, and marks where the answer is not plain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props as P
from ..functions import text as T
from ..model import LAW, Graph
from ..storage import materialise
from .census import best, peaks
from .emit import pack_lines
from .govern import touching
from .walks import context_pack


#: Keys that properties are narrowed to before they meet the cues.
FEW_KEYS = 16


def hits(graph: Graph, cues: DataFrame) -> DataFrame:
    """``(cue, hid, tag, props)``: the nodes that ``cues(cue, tag, key, value)`` name by kind and one property; rules are none."""
    asked = materialise(cues.select("cue", F.upper("tag").alias("tag"), "key", "value"), "asked")
    found = graph.nodes.where(F.col("tag") != LAW).select("hid", "tag", "props", F.explode("props").alias("key", "value"))
    keys = [r[0] for r in asked.select("key").distinct().limit(FEW_KEYS + 1).collect()]
    if len(keys) <= FEW_KEYS:
        found = found.where(F.col("key").isin(*keys))
    return found.join(asked, ["tag", "key", "value"]).select("cue", "hid", "tag", "props")


def _listed(rows: DataFrame, most: int) -> DataFrame:
    """``(cue, k, line)``: the first rows of each cue by rank, as shaped lines."""
    k = F.row_number().over(Window.partitionBy("cue").orderBy("tag", P.payload(), "hid"))
    return rows.withColumn("k", k).where(F.col("k") <= most).select("cue", "k", T.shaped_node(F.col("tag"), T.shown(with_nickname=False)).alias("line"))


def compose(graph: Graph, cues: DataFrame, depth: int = 2, max_rows: int | None = None, leases: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """``(cue, position, line)``: the answer to each of ``cues(cue, tag, key, value)``.

    * A cue that names one node: marks of what was cut and of leases that cover the view, then rules, nodes and edges around it.
    * Several nodes: a conflict mark with their number, and the first of them; none is picked.
    * None: a miss mark, and the nodes with more edges than any neighbour; if there is one alone, it is walked from.

    Lines are bounded by ``max_rows`` for each cue.
    """
    most = graph.limits.rows if max_rows is None else max_rows
    found = materialise(hits(graph, cues), "cue-hits")
    counted = materialise(cues.select("cue").distinct().join(found.groupBy("cue").agg(F.count(F.lit(1)).alias("n")), "cue", "left").select("cue", F.coalesce("n", F.lit(0)).alias("n")), "cues")
    several = found.join(counted.where("n > 1"), "cue", "left_semi")
    one = found.join(counted.where("n = 1"), "cue", "left_semi").select(F.col("cue").alias("pack"), F.col("hid").alias("node"))
    mark = lambda df, section, line: df.select("cue", F.lit(section).alias("section"), F.lit(0).alias("k"), line.alias("line"))
    parts = [mark(counted.where("n > 1"), 0, F.concat(F.lit("## CueConflict |Q|="), F.col("n").cast("string")))]
    parts.append(_listed(several, most).select("cue", F.lit(3).alias("section"), "k", "line"))
    missed = counted.where("n = 0")
    if not missed.isEmpty():
        top = materialise(peaks(graph), "peaks")
        n = top.count()
        parts.append(mark(missed, 0, F.lit("## CueMiss MATCH_L=0")))
        parts.append(mark(missed, 1, F.lit(f"## Peak_L |Q|={n}")))
        first = best(graph, top, most)  # max_rows of them at most
        each = missed.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one")
        if n == 1:
            one = one.union(each.select("cue", "hid"))
        else:
            parts.append(_listed(each.select("cue", "hid", "tag", "props"), most).select("cue", F.lit(3).alias("section"), "k", "line"))
    notes: list[DataFrame] = []
    pack = materialise(context_pack(graph, one, depth, most, active_only=True, notes=notes), "pack")
    clipped = notes[0].select(F.col("pack").alias("cue"), "offered", "kept")
    parts.append(mark(clipped, 2, F.concat(F.lit(f"## Truncation truncated=true M={most} omitted="), (F.col("offered") - F.col("kept")).cast("string"), F.lit(" reason=max_rows"))))
    parts.append(pack_lines(graph, pack).select(F.col("pack").alias("cue"), F.lit(4).alias("section"), F.col("position").alias("k"), "line"))
    if leases is not None and now is not None:
        parts.append(_reserves(pack, leases, now))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("cue").orderBy("section", "k", "line"))).select("cue", "position", "line")


def _reserves(pack: DataFrame, leases: DataFrame, now: str) -> DataFrame:
    """The leases that cover rows of each pack, as lines under a mark."""
    when = F.lit(now).cast("timestamp")
    live = touching(leases, pack.select("hid").distinct(), now)
    covered = leases.where(F.col("until") > when).select("rid", "hid").join(pack.select(F.col("pack").alias("cue"), "hid"), "hid").select("cue", "rid").distinct().join(live, "rid")
    until = F.date_format("until", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    left = F.unix_timestamp("until") - F.unix_timestamp(when)
    line = F.concat(F.lit("RSV ["), F.col("rid"), F.lit("] ; llm_id="), F.col("holder"), F.lit(" ; anchor="), F.col("anchor"), F.lit(" ; until="), until, F.lit(" ; left_s="), left.cast("string"))
    lines = covered.select("cue", F.lit(3).alias("section"), F.lit(1).alias("k"), line.alias("line"))
    return lines.select("cue").distinct().select("cue", F.lit(3).alias("section"), F.lit(0).alias("k"), F.lit("## Reserves").alias("line")).union(lines)


def summary(rows: DataFrame, most: int = 48, width: int = 80, keys: tuple[str, ...] = ("name", "title", "goal", "status", "kind")) -> DataFrame:
    """``(position, hid, tag, fields)``: the first ``most`` rows of a slice by rank, with short fields only, cut to ``width`` characters."""
    order = [F.col("tag"), P.payload(), F.col("hid")]
    top = rows.orderBy(*order).limit(most)
    short = F.transform_values(F.map_filter("props", lambda k, v: k.isin(*keys) & (v != "")), lambda k, v: F.when(F.length(v) > width, F.concat(F.substring(v, 1, width - 1), F.lit("…"))).otherwise(v))
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", "hid", "tag", short.alias("fields"))
