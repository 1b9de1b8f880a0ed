"""Best-fit-decreasing packing with a segment tree over remaining capacities.

Best fit decreasing takes pieces from long to short and puts each into the open bin
with the least room that still fits.  Pieces of one length are interchangeable, and
so are bins with the same room, so the decisions depend on nothing but how many
pieces have each length: ``capacity`` numbers, whatever the size of the data.  The
plan is made from those numbers as *runs* (pieces ``from`` .. ``to`` of a length go
to that many neighbouring bins, at one offset); Spark numbers the pieces of every
length and looks each one up in the runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .tokens import default_path, encoder

EOD = 0
#: Pieces of a length are numbered in buckets of about so many rows, of at most MOST_BUCKETS.
BUCKET_ROWS, MOST_BUCKETS = 512, 65536


class RoomTree:
    """Segment tree over rooms 0 .. capacity: the bins open at each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open bin has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs ``(length, first piece, pieces, first bin, offset)``, by length and first piece.

    ``counts``: how many pieces have each length of 1 .. capacity.
    """
    tree, open_bins, runs, bins = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, piece = counts[length], 0
        while left:
            # A bin that gets a piece is the tightest from then on, so it goes on getting pieces while they fit.
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for base, many, slots in ((first, full, each), (first + full, 1, rest)):
                for slot in range(slots if many else 0):
                    runs.append((length, piece, many, base, capacity - room + slot * length))
                    piece += many
            put(room - each * length, first, full)
            put(room - rest * length, first + full, min(rest, 1))
            put(room, first + full + min(rest, 1), n - full - min(rest, 1))
            left -= full * each + rest
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each document's ids and the id 0, in pieces of at most ``capacity``.

    Only a document longer than ``capacity`` is cut, into full pieces after a first one that holds the rest.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([EOD], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for row, text in enumerate(part.column(1)):
                    ids = np.concatenate([own.ids(text.as_py()), end])
                    n = len(ids)
                    start, piece = 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        rows.append((row, piece, start, length, zlib.crc32(ids[start : start + length])))
                        start, piece = start + length, piece + 1
                made = np.array(rows, dtype=np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(made[:, 0])), pa.array(made[:, 1].astype(np.int32)), *(pa.array(made[:, i]) for i in (2, 3, 4))], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best fit decreasing over ``length``.

    ``pieces`` has to be stored (it is read more than once), with ``id``, ``piece`` and a
    ``length`` of 1 .. capacity.  Equal rows are told apart; null ids are packed like others;
    an empty table gives an empty table.
    """
    found = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    if any(not 1 <= n <= capacity for n in found):
        raise ValueError(f"lengths have to be 1 .. {capacity}")
    runs = plan(found, capacity)
    buckets = min(MOST_BUCKETS, 1 + sum(found.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "bucket"]).withColumn("nth", F.col("first") + F.col("nth") - 1)
    key = runs[:, 0] * 2**48 + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth = batch.column("nth").to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(key, batch.column("length").to_numpy(zero_copy_only=False) * 2**48 + nth, side="right") - 1]
            rest = [n for n in batch.schema.names if n != "nth"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(run[:, 3] + nth - run[:, 1]), pa.array(run[:, 4])], names=[*rest, "sequence_id", "offset"])

    kept = [c for c in pieces.columns]
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*kept, "nth").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document, packed: see :func:`token_pieces` and :func:`pack`.

    * A null or empty text is the id 0 alone; a null id is kept.
    * Repeated rows are each packed; extra columns are ignored.
    """
    return pack(materialise(token_pieces(docs, capacity, path, id_col, text_col), "pieces"), capacity)
