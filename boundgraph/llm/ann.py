"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are listed under the nearest of about ``sqrt(n)`` centres, which k-means finds in a
bounded sample.  Relative to its centre a vector is brought to length one,
rotated at random and reduced to the signs of its components, packed into bits.  Two
correction scalars go with a code: the vector's distance from the centre, and how much
of it the code explains.  A rotated query, quantised to ``QUERY_BITS`` bits, meets a
code by counting bits; the estimate of the inner product is unbiased, and its error
exceeds ``bound`` times its standard scale rarely (Gao and Long, 2024).  Only vectors
whose upper bound reaches the k-th inner product found so far are reranked, by the
inner product of the original vectors in double precision.

How many lists a query reads is measured: for ``TRIALS`` queries the exact neighbours are found in one
pass over the table, and as many lists are read as hold ``REACH`` of these.  Clustered vectors need
few; of vectors without any structure most lists have to be read, whatever the index.

Lists are gathered into blocks that a task holds; a vector goes to one block and is coded there
once, and the queries of a block stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embed_dedup import stacked, usable
from .shared import materialise

QUERY_BITS = 5
#: Rows of the sample that the centres come from; lists at most; steps of k-means.
SAMPLE, MOST_LISTS, ROUNDS = 32768, 4096, 6
#: Queries that measure how many lists are read, and the share of their neighbours that these hold.
TRIALS, REACH = 64, 0.98
#: Numbers in a block of vectors at most (fewer where there would be fewer blocks than cores), and queries that stream past one copy of a block.
BLOCK_NUMBERS, QUERIES = 1 << 23, 1 << 18
#: Pairs whose inner products are estimated in one step.
TILE = 1 << 20


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, to at least ``dim`` and a multiple of 64 columns."""
    wide = max(64, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


class Codes:
    """Packed codes and correction scalars of the rows of ``x`` relative to ``centre``."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        away = (x - centre) @ turn
        self.centre, self.turn, self.wide = centre, turn, turn.shape[1]
        length = np.sqrt((away * away).sum(axis=1))
        unit = away / np.where(length > 0, length, 1)[:, None]
        ones = unit > 0
        self.bits = np.packbits(ones, axis=1, bitorder="little").view("<u8")
        self.count = ones.sum(axis=1).astype(np.float32)
        explained = np.where(length > 0, np.abs(unit).sum(axis=1) / np.sqrt(self.wide), 1)
        self.scale = (length / explained).astype(np.float32)
        self.spread = (length * np.sqrt(np.maximum(1 - explained**2, 0)) / explained / np.sqrt(max(self.wide - 1, 1))).astype(np.float32)

    def estimates(self, asked: Asked, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products ``(queries, rows)`` and the standard scale of their errors, in single precision."""
        shape = len(which), len(self.bits)
        both, ones, part = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, np.uint32)
        dot = np.zeros(shape, np.uint32)
        for b, plane in enumerate(asked.planes):
            for w in range(plane.shape[1]):
                np.bitwise_and(plane[which, w, None], self.bits[None, :, w], out=both)
                np.bitwise_count(both, out=ones)
                np.multiply(ones, np.uint32(1 << b), out=part, dtype=np.uint32)
                dot += part
        step, low, root = asked.step[which], asked.low[which], np.float32(self.wide**0.5)
        guess = dot.astype(np.float32)
        guess *= 2 * step / root
        guess += (2 * low / root) * self.count
        guess -= asked.total[which] / root
        guess *= self.scale
        guess += (asked.queries[which] @ self.centre)[:, None].astype(np.float32)
        return guess, asked.norm[which] * self.spread + (step / np.float32(12**0.5)) * self.scale


class Asked:
    """Rotated queries, quantised to bit planes."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray):
        q = queries @ turn
        low = q.min(axis=1, keepdims=True)
        step = np.maximum((q.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-30)
        level = np.rint((q - low) / step).astype(np.int64)
        self.queries = queries
        self.planes = [np.packbits((level >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(QUERY_BITS)]
        self.step, self.low = step.astype(np.float32), low.astype(np.float32)
        self.total = (step * level + low).sum(axis=1, keepdims=True).astype(np.float32)
        self.norm = np.sqrt((q * q).sum(axis=1, keepdims=True)).astype(np.float32)


class Block:
    """Vectors that a task holds, by list: coded once, then searched by any number of queries."""

    def __init__(self, lists: np.ndarray, x: np.ndarray, ids: pa.ListArray, centres: np.ndarray, turn: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.x, self.turn = x[order], turn
        self.n_ids = np.diff(ids.offsets.to_numpy())[order]
        self.first = ids.offsets.to_numpy()[:-1][order]
        self.ids = ids.values.to_numpy()
        owner = np.repeat(np.arange(len(order)), self.n_ids)
        flat = self.ids[np.repeat(self.first - np.cumsum(self.n_ids) + self.n_ids, self.n_ids) + np.arange(len(owner))]
        by_id = np.argsort(flat, kind="stable")
        self.sorted_ids, self.owner = flat[by_id], owner[by_id]
        names, starts = np.unique(lists[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        self.parts = {n: (s, e, Codes(self.x[s:e], centres[n], turn)) for n, s, e in zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True)}

    def search(self, own: np.ndarray, probes: list[np.ndarray], queries: np.ndarray, k: int, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(query ids, ids, inner products)``: for each query the ``k`` best of what it has to rerank in its lists, without its own id."""
        rows = max(1, TILE // max(1, len(self.x)))
        for at in range(0, len(queries), rows):
            asked = Asked(queries[at : at + rows], self.turn)
            shape = len(asked.queries), len(self.x)
            guess, upper = np.full(shape, -np.inf, np.float32), np.full(shape, -np.inf, np.float32)
            wanted: dict[int, list[int]] = {}
            for n in range(shape[0]):
                for name in probes[at + n].tolist():
                    wanted.setdefault(name, []).append(n)
            for name, which in wanted.items():
                if name in self.parts:
                    s, e, codes = self.parts[name]
                    g, error = codes.estimates(asked, np.array(which))
                    guess[which, s:e] = g
                    upper[which, s:e] = g + np.float32(bound) * error
            for n in range(shape[0]):
                q, me = queries[at + n], own[at + n]
                lo, hi = np.searchsorted(self.sorted_ids, [me, me + 1])
                alone = self.owner[lo:hi][self.n_ids[self.owner[lo:hi]] == 1]  # vectors that nothing but the query's own id has
                guess[n, alone] = upper[n, alone] = -np.inf
                floor = -np.inf
                if shape[1] > k:  # the least of the k that look best: the k-th best of all is no less
                    look = np.argpartition(guess[n], -k)[-k:]
                    if not np.isinf(guess[n, look]).any():
                        floor = (self.x[look] * q).sum(axis=1).min()
                found = np.flatnonzero((upper[n] >= floor) & (upper[n] > -np.inf))
                if not len(found):
                    continue
                score = (self.x[found] * q).sum(axis=1)
                if len(found) > k:
                    near = score >= np.partition(score, -k)[-k]
                    found, score = found[near], score[near]
                many = self.n_ids[found]
                place = np.repeat(self.first[found] - np.cumsum(many) + many, many) + np.arange(many.sum())
                ids, score = self.ids[place], np.repeat(score, many)
                ids, score = ids[ids != me], score[ids != me]
                top = np.lexsort((ids, -score))
                ids, score = ids[top], score[top]
                new = np.ones(len(ids), dtype=bool)
                new[1:] = (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
                ids, score = ids[new][:k], score[new][:k]
                yield np.full(len(ids), me), ids, score


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row."""
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(x), dtype=np.int32)
    for at in range(0, len(x), 2048):
        out[at : at + 2048] = (x[at : at + 2048] @ centres.T - half).argmax(axis=1)
    return out


def found_centres(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres of ``lists`` lists by k-means, neighbours beside each other."""
    centres = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)].astype(np.float64)
    for _ in range(rounds if lists > 1 else 1):
        at = nearest(x, centres)
        order = np.argsort(at, kind="stable")
        names, starts = np.unique(at[order], return_index=True)
        centres[names] = np.add.reduceat(x[order].astype(np.float64), starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]

    def ordered(which: np.ndarray) -> np.ndarray:
        if len(which) < 3:
            return which
        away = centres[which] - centres[which].mean(axis=0)
        along = np.linalg.eigh(away.T @ away)[1][:, -1]
        which = which[np.argsort(away @ along, kind="stable")]
        return np.concatenate([ordered(which[: len(which) // 2]), ordered(which[len(which) // 2 :])])

    return centres[ordered(np.arange(len(centres)))]


def probed(queries: np.ndarray, centres: np.ndarray, counts: np.ndarray, probes: int, k: int) -> list[np.ndarray]:
    """The lists that each query reads: ``probes``, and more while they hold no more than ``k`` vectors."""
    order = np.argsort(-(queries @ centres.T), axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1)
    many = np.maximum(probes, (held <= k).sum(axis=1) + 1)
    return [o[:n].astype(np.int32) for o, n in zip(order, many.tolist(), strict=True)]


def _sizes(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each length of ``vec``, with the vectors as rows of doubles."""
    sizes = _sizes(batch.column("vec"))
    for size in np.unique(sizes).tolist():
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        yield size, part, stacked(part.column("vec"))


def search(table: DataFrame, queries: DataFrame, k: int = 20, bound: float = 3.0, reach: float = REACH, block: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` largest inner products found for every query, ties to the smaller id.

    ``queries`` has the columns of ``table``.  ``block``: vectors that a task holds at once.  With
    fewer than ``k`` candidates all are returned.

    * Vectors that are null, zero or hold null or non-finite components take no part; neither do null ids.
    * Only vectors of the same length meet.
    * Equal vectors are one entry of the index with the ``k + 1`` smallest of their ids, which is all that can be among the ``k`` best.
    * Rows that repeat an id are found once per score; a query is never its own id's candidate; a
      repeated query is searched for each different vector, and the best of all is returned once.
    * An empty table gives an empty table; further columns are ignored.
    """
    kind = dict(table.select(F.col(vec_col).alias("vec")).dtypes)["vec"]

    def rows(df: DataFrame) -> DataFrame:
        good = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
        return good.where(F.col("id").isNotNull() & usable("vec")).distinct()

    smallest = Window.partitionBy("vec").orderBy("id")
    first = rows(table).withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    entries = materialise(first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("vec", "ids"), "entries")
    asked = materialise(rows(queries), "queries")
    n = entries.count()
    drawn = entries.orderBy(F.xxhash64("vec"), "ids").limit(SAMPLE).select("vec").toArrow().combine_chunks()
    centres: dict[int, np.ndarray] = {}
    for batch in drawn.to_batches():
        for size, part, x in _by_size(batch):
            lists = int(min(MOST_LISTS, max(1, (n * len(part) / drawn.num_rows) ** 0.5), max(1, len(part) / 8)))
            centres[size] = found_centres(x, lists)

    def listed(size: int, x: np.ndarray) -> np.ndarray:
        """Lists of vectors; lengths that the sample does not have are one list each."""
        return nearest(x, centres[size]) if size in centres else np.zeros(len(x), dtype=np.int32)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {s: np.zeros(len(c), dtype=np.int64) for s, c in centres.items()}
        for batch in batches:
            for size, _, x in _by_size(batch):
                if size in found:
                    found[size] += np.bincount(listed(size, x), minlength=len(found[size]))
        for size, many in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), size, np.int32)), pa.array(np.arange(len(many), dtype=np.int32)), pa.array(many)], names=["size", "list", "n"])

    counts = {s: np.zeros(len(c), dtype=np.int64) for s, c in centres.items()}
    for r in entries.select("vec").mapInArrow(counted, "size int, list int, n long").groupBy("size", "list").agg(F.sum("n").alias("n")).collect():
        counts[r["size"]][r["list"]] = r["n"]
    probes = _probes(entries, asked, centres, k, reach)
    cores = table.sparkSession.sparkContext.defaultParallelism
    group: dict[int, np.ndarray] = {}  # of each list; blocks are filled with neighbouring lists
    parts: dict[int, np.ndarray] = {}  # of each list: a list beyond a block is dealt over several
    for size, many in counts.items():
        most = block or int(min(max(1, BLOCK_NUMBERS // size), max(512, many.sum() / (3 * cores))))
        parts[size] = np.maximum(1, -(-many // most))
        at, room, group[size] = 0, most, np.zeros(len(many), dtype=np.int32)
        for i, c in enumerate(many.tolist()):
            if i and (c > room or parts[size][i] > 1 or parts[size][i - 1] > 1):
                at, room = at + 1, most
            group[size][i] = at
            room -= c
    cells = sum(int(parts[s][np.unique(g, return_index=True)[1]].sum()) for s, g in group.items())

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for size, part, q in _by_size(batch.slice(at, 1024)):
                    which = probed(q, centres[size], counts[size], probes[size], k) if size in centres else [np.zeros(1, np.int32)] * len(q)
                    row, own_group, own_part, lists = [], [], [], []
                    for i, names in enumerate(which):
                        groups = group[size][names] if size in centres else names
                        for g in np.unique(groups).tolist():
                            mine = names[groups == g]
                            for p in range(int(parts[size][mine[0]]) if size in centres else 1):
                                row.append(i)
                                own_group.append(g)
                                own_part.append(p)
                                lists.append(mine)
                    taken = part.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size, np.int32)), pa.array(own_group, pa.int32()), pa.array(own_part, pa.int32()), pa.array(lists, pa.list_(pa.int32())), taken.column("vec"), taken.column("id")], names=["size", "grp", "part", "lists", "vec", "id"])

    questions = asked.mapInArrow(asking, f"size int, grp int, part int, lists array<int>, vec {kind}, id long")
    crowds = {(r["size"], r["grp"]): -(-r["n"] // QUERIES) for r in questions.where("part = 0").groupBy("size", "grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > QUERIES).collect()}  # blocks that more queries ask than stream past one copy

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part, x in _by_size(batch):
                names = listed(size, x)
                groups = group[size][names] if size in centres else names
                many = parts[size][names] if size in centres else np.ones(len(x), dtype=np.int64)
                own = np.array([i.values[0].as_py() for i in part.column("ids")], dtype=np.int64) % many
                copies = np.array([crowds.get((size, g), 1) for g in groups.tolist()], dtype=np.int64)
                row = np.repeat(np.arange(len(x)), copies)
                crowd = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size, np.int32)), pa.array(groups[row].astype(np.int32)), pa.array(own[row].astype(np.int32)), pa.array(crowd.astype(np.int32)), pa.array([[i] for i in names[row].tolist()], pa.list_(pa.int32())), taken.column("vec"), taken.column("ids")], names=["size", "grp", "part", "crowd", "lists", "vec", "ids"])

    entered = entries.mapInArrow(placed, f"size int, grp int, part int, crowd int, lists array<int>, vec {kind}, ids array<long>")
    crowded = F.lit(0)
    for (size, g), many in crowds.items():  # a row for QUERIES queries of a block
        crowded = F.when((F.col("size") == size) & (F.col("grp") == g), F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).otherwise(crowded)
    key = ["size", "grp", "part", "crowd"]
    both = entered.withColumn("asks", F.lit(False)).unionByName(questions.select("size", "grp", "part", crowded.alias("crowd"), "lists", "vec", F.array("id").alias("ids"), F.lit(True).alias("asks")))
    tasks = max(1, min(cells + sum(crowds.values()), max(4 * cores, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    turns = {size: rotation(size) for size in centres}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, ready = None, [], None
        for batch in batches:
            codes = np.stack([batch.column(c).to_numpy() for c in key] + [batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int32)], axis=1)
            starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1))) if len(codes) else []
            for s, e in zip(starts, np.append(starts[1:], len(codes)), strict=True):
                part, now = batch.slice(s, e - s), tuple(codes[s, :4].tolist())
                if now != here:
                    here, waiting, ready = now, [], None
                if not codes[s, 4]:
                    waiting.append(part)
                    continue
                if ready is None:
                    if not waiting:
                        continue
                    whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    size, waiting = now[0], []
                    turn = turns.get(size)
                    ready = Block(whole.column("lists").flatten().to_numpy(), stacked(whole.column("vec")), pa.ListArray.from_arrays(whole.column("ids").offsets, whole.column("ids").values), centres.get(size, np.zeros((1, size))), rotation(size) if turn is None else turn)
                probes_of = [x.values.to_numpy() for x in part.column("lists")]
                found = list(ready.search(part.column("ids").flatten().to_numpy(), probes_of, stacked(part.column("vec")), k, bound))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "id", "score"])

    met = both.repartition(tasks, *key).sortWithinPartitions(*key, "asks").mapInArrow(run, "query_id long, id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _probes(entries: DataFrame, asked: DataFrame, centres: dict[int, np.ndarray], k: int, reach: float) -> dict[int, int]:
    """For each length how many lists hold the share ``reach`` of the exact neighbours of ``TRIALS`` queries, by one pass over the vectors."""
    trial: dict[int, list] = {}
    for r in asked.orderBy(F.xxhash64("id", "vec")).limit(TRIALS).select("vec").collect():
        trial.setdefault(len(r["vec"]), []).append(r["vec"])
    tried = {size: np.array(v, dtype=np.float64) for size, v in trial.items() if size in centres}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {size: (np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int32)) for size, q in tried.items()}
        for batch in batches:
            for size, _, x in _by_size(batch):
                if size in tried:
                    score, names = kept[size]
                    score = np.concatenate([score, tried[size] @ x.T], axis=1)
                    names = np.concatenate([names, np.broadcast_to(nearest(x, centres[size]), (len(score), len(x)))], axis=1)
                    if score.shape[1] > k + 1:
                        top = np.argpartition(score, -k - 1, axis=1)[:, -k - 1 :]
                        score, names = np.take_along_axis(score, top, axis=1), np.take_along_axis(names, top, axis=1)
                    kept[size] = score, names
        for size, (score, names) in kept.items():
            row = np.repeat(np.arange(len(score), dtype=np.int32), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size, np.int32)), pa.array(row), pa.array(score.ravel()), pa.array(names.ravel())], names=["size", "row", "score", "list"])

    out = {size: len(c) for size, c in centres.items()}
    ranks: dict[int, list[int]] = {}
    order = {size: np.argsort(np.argsort(-(q @ centres[size].T), axis=1, kind="stable"), axis=1) for size, q in tried.items()}
    per = Window.partitionBy("size", "row").orderBy(F.desc("score"))
    found = entries.select("vec").mapInArrow(best, "size int, row int, score double, list int").withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= k + 1)
    for r in found.collect() if tried else []:
        ranks.setdefault(r["size"], []).append(int(order[r["size"]][r["row"], r["list"]]))
    for size, found_at in ranks.items():
        out[size] = sorted(found_at)[int(np.ceil(reach * len(found_at))) - 1] + 1
    return out
