"""Token counts by a separator scan of flat token files.

A token file is nothing but little-endian ids, each document's followed by an
end-of-document id; there is no index.  Files are cut into blocks that tasks search
on their own, all ids of a block at once.  A block's summary says how many separators
it has and where the first and the last stand; prefix sums over the summaries of a
file then give each block's first document number and where the document that it
begins in the midst of began, so documents across any number of blocks are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt, fresh_path, materialise, reading, store
from .tokens import default_path, encoder

#: End-of-document id of the vocabulary; no text has it, as its string in a text is ordinary text.
EOD = 50256
BLOCK_BYTES = 4 * 1024 * 1024


def write(docs: DataFrame, folder: str | None = None, eod: int = EOD, width: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids to flat files, one for each task; ``(file, nth, id)`` says where each went.

    Null and empty texts are a separator alone; null ids and repeated rows are written like others;
    no rows give no file.
    """
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    path = path or default_path()
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.bin"
        ids: list[pa.Array] = []
        end = np.array([eod], dtype=kind).tobytes()

        def chunks(first: pa.RecordBatch) -> Iterator[bytes]:
            own = encoder(path, spelled=True)
            for batch in chain([first], batches):
                ids.append(batch.column(0))
                for text in batch.column(1):
                    yield own.ids(text.as_py()).astype(kind).tobytes() + end

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            store(uri, chunks(first))
            at = 0
            for part in ids:
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(part)), pa.array(np.arange(at, at + len(part))), part], names=["file", "nth", "id"])
                at += len(part)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, "file string, nth long, id long"), "manifest")


def scan(files: DataFrame, eod: int = EOD, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, nth, n_tokens)``: the length of every document of ``files(file)``, without its separator.

    What stands after the last separator of a file is a document too if there is anything.
    A file's length has to be a multiple of ``width``.  An empty file has no document.
    """
    kind = np.dtype(f"<u{width}")
    step = max(1, block_bytes // width) * width

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with reading(uri) as f:
                    size = f.size()
                if size % width:
                    raise ValueError(f"{uri} does not hold whole ids")
                starts = np.arange(0, size, step)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(starts), pa.string()), pa.array(np.arange(len(starts))), pa.array(starts), pa.array(np.minimum(step, size - starts))], names=["file", "block", "start", "size"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with reading(uri) as f:
                    f.seek(start)
                    ids = np.frombuffer(f.read(size), dtype=kind)
                at = np.flatnonzero(ids == eod)
                inner = pa.array([np.diff(at) - 1], pa.list_(pa.int64()))
                first, last = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block]), pa.array([len(ids)]), pa.array([len(at)]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), inner], names=["file", "block", "ids", "ends", "first", "last", "inner"])

    blocks = materialise(files.select("file").distinct().mapInArrow(cut, "file string, block long, start long, size long"), "cuts")
    n, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = dealt(blocks, n, total, "file", "block")
    found = materialise(blocks.mapInArrow(search, "file string, block long, ids long, ends long, first long, last long, inner array<long>"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select("file", "block", "ids", "ends", "first", "last", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("nth"))
    stitched = placed.select("file", "block", "nth", (F.col("at") + F.col("first") - F.coalesce(F.max(F.col("at") + F.col("last")).over(before), F.lit(-1)) - 1).alias("head"))
    joined = found.where("ends > 0").select("file", "block", "inner").join(stitched, ["file", "block"])
    whole = joined.select("file", "nth", F.posexplode(F.concat(F.array("head"), "inner")).alias("more", "n_tokens")).select("file", (F.col("nth") + F.col("more")).alias("nth"), "n_tokens")
    ends = placed.groupBy("file").agg(F.sum("ids").alias("ids"), F.sum("ends").alias("nth"), F.coalesce(F.max(F.col("at") + F.col("last")), F.lit(-1)).alias("last"))
    return whole.union(ends.where("ids > last + 1").select("file", "nth", F.col("ids") - F.col("last") - 1))


def count(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens)`` of every row, by writing token files and scanning them."""
    manifest = write(docs, path=path, id_col=id_col, text_col=text_col)
    return manifest.join(scan(manifest, block_bytes=block_bytes), ["file", "nth"]).select("id", "n_tokens")
