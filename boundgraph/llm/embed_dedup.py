"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its ``named`` nearest of a set of reference points, nearest
first.  Inverted lists hold, for every reference point and label, the vectors that
name it among their first ``listed``; vectors that meet in a list and share at least
``shared`` named points are candidates, and candidates are verified by their cosine
in double precision.  Vectors that nearly coincide name nearly the same points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialise
from .simhash import local_roots

#: Rows that one block of an inverted list holds; longer lists are dealt into blocks that meet in pairs.
BLOCK = 1024
#: Bounds on the number of reference points, and the cosine that two of them stay below.
FEWEST, MOST, APART = 64, 4096, 0.8
#: Candidates that are verified in one step.
STEP = 32768


def usable(vector: str) -> Column:
    """Whether a vector column is neither null nor zero and holds finite numbers only."""
    c = F.col(vector)
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))


def stacked(column: pa.Array) -> np.ndarray:
    """A batch of equally long vectors as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def reference_points(vectors: DataFrame, points: int) -> np.ndarray:
    """Unit vectors drawn by hash of the id, at most ``points``, none closer to another than ``APART``.

    Twice as many are drawn and thinned, so that a crowd of near copies gives one point.
    """
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(2 * points).select("vec").collect()
    kept = np.zeros((points, max((len(r["vec"]) for r in drawn), default=1)))
    n = 0
    for r in drawn:
        v = np.zeros(kept.shape[1])
        v[: len(r["vec"])] = r["vec"]
        v /= np.abs(v).max()
        v /= np.linalg.norm(v)
        if n < points and (n == 0 or (kept[:n] @ v).max() < APART):
            kept[n] = v
            n += 1
    return kept[:n]


def permutations(unit: np.ndarray, points: np.ndarray, named: int) -> np.ndarray:
    """The ``named`` nearest reference points of every row, nearest first."""
    near = -(unit @ points[:, : unit.shape[1]].T)
    named = min(named, near.shape[1])
    first = np.argpartition(near, named - 1, axis=1)[:, :named]
    order = np.argsort(np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
    return np.take_along_axis(first, order, axis=1).astype(np.int32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def close_pairs(unit: np.ndarray, perms: np.ndarray, group: np.ndarray, point: np.ndarray, listed: int, shared: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows of one list, each in only the least point under which both are listed."""
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], group[order], side="right")
    n = ends - np.arange(len(order)) - 1
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, side="right")) - 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], n[at:to])
        i, j = order[i], order[j]
        both = (perms[i][:, :, None] == perms[j][:, None, :])
        good = both.sum(axis=(1, 2)) >= min(shared, perms.shape[1])
        i, j, both = i[good], j[good], both[good]
        met = both[:, :listed, :listed].any(axis=2)
        least = np.where(met, perms[i][:, :listed], np.iinfo(np.int32).max).min(axis=1)
        own = least == point[i]
        i, j = i[own], j[own]
        near = (unit[i] * unit[j]).sum(axis=1) >= cosine
        yield i[near], j[near]
        at = to


def links(vectors: DataFrame, cosine: float, points: np.ndarray, named: int, listed: int, shared: int, block: int) -> DataFrame:
    """``(a, b, n)``: with ``b`` null, ``n`` more links of ``a``; else a connection of ``a`` and ``b``.

    ``vectors(id, label, vec, copies)`` has every different vector of a label once.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                perms = permutations(unit_rows(stacked(part.column("vec"))), points, named)
                for at in range(min(listed, perms.shape[1])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(perms[:, at])), pa.array(np.full(len(perms), size, np.int32)), *(part.column(c) for c in ("label", "id", "copies", "vec")), pa.array(list(perms), pa.list_(pa.int32()))], names=["point", "size", "label", "id", "copies", "vec", "perm"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids, copies = (one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("id", "copies"))
                unit = unit_rows(stacked(one.column("vec").flatten()))
                perms = np.stack(one.column("perm").flatten().to_numpy(zero_copy_only=False))
                order = np.argsort(ids)
                ids, copies, unit, perms = ids[order], copies[order], unit[order], perms[order]
                side = one.column("side").flatten().to_numpy(zero_copy_only=False)[order]
                degree, found = np.zeros(len(ids), dtype=np.int64), []
                point = np.full(len(ids), one.column("point")[0].as_py())
                for i, j in close_pairs(unit, perms, np.zeros(len(ids), dtype=np.int64), point, listed, shared, cosine):
                    if one.column("split")[0].as_py():  # blocks meet in pairs: links within one are counted where it stands alone
                        across = side[i] != side[j]
                        i, j = i[across], j[across]
                    degree += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                    found.append((i, j))
                root = local_roots(len(ids), iter(found))
                hung, linked = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(degree)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[linked], ids[hung]])), pa.array(np.concatenate([np.zeros(len(linked), np.int64), ids[root[hung]]]), mask=np.arange(len(linked) + len(hung)) < len(linked)), pa.array(np.concatenate([degree[linked], np.zeros(len(hung), np.int64)]))], names=["a", "b", "n"])

    lists = ["id", "copies", "vec", "perm"]
    bucket = ["label", "size", "point"]
    keyed = vectors.mapInArrow(keys, f"point int, size int, label {dict(vectors.dtypes)['label']}, id long, copies long, vec {dict(vectors.dtypes)['vec']}, perm array<int>")
    sizes = keyed.select(*bucket).groupBy(*bucket).count().where("count > 1")
    blocks = (
        keyed.join(sizes, bucket)
        .withColumn("parts", F.ceil(F.col("count") / block))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .groupBy(*bucket, "parts", "part")
        .agg(F.collect_list(F.struct(*lists)).alias("r"))
        .select(*bucket, "parts", "part", *(F.col(f"r.{n}").alias(n) for n in lists))
        .withColumn("side", F.transform("id", lambda _: F.col("part")))
    )
    lists.append("side")
    blocks = materialise(blocks, "lists")
    alone = blocks.select("point", F.lit(False).alias("split"), *lists)
    left, right = blocks.where("parts > 1"), blocks.where("parts > 1").select(*bucket, F.col("part").alias("other"), *(F.col(n).alias(f"{n}_r") for n in lists))
    met = left.join(right, bucket).where("part < other").select("point", F.lit(True).alias("split"), *(F.concat(n, f"{n}_r").alias(n) for n in lists))
    return alone.union(met).mapInArrow(forest, "a long, b long, n long")


def near_duplicates(table: DataFrame, cosine: float = 0.98, named: int = 8, listed: int = 5, shared: int = 2, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component)`` for every row: how many vectors it is linked with, and the least id reachable.

    Vectors are linked if their labels are equal and not null and their cosine is at
    least ``cosine``.  Equal vectors of a label are one entry of the index, with as many
    copies; reference points number about four times the square root of the vectors.

    * Null or zero vectors, those that hold null or non-finite components, those without
      a label or id link with nothing: ``n_links`` 0, ``component`` their own id.
    * Only vectors of the same length are compared.
    * Repeated rows are copies of each other; rows that share an id each count as a vector.
    * An empty table gives an empty table; further columns are ignored.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & usable("vec")
    classes = materialise(rows.where(good).groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "label", "vec", "copies"), "classes")
    n = classes.count()
    found = materialise(links(classes, cosine, reference_points(classes, min(MOST, max(FEWEST, int(4 * n**0.5)))), named, listed, shared, block), "links")
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    component = connected_components(found.where("b is not null")).withColumnRenamed("node", "id")
    summed = classes.join(degree, "id", "left").join(component, "id", "left").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    linked = rows.where(good).join(summed, ["label", "vec"]).select("id", "n_links", "component")
    return linked.union(rows.where(~good).select("id", F.lit(0).cast("long"), "id"))
