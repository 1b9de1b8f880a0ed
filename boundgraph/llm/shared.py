"""What the operators have in common: shared storage and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, materialise, shared_dir  # noqa: F401


def release() -> None:
    """Give memory that Arrow and numpy have freed back to the system; where libc can't, nothing happens."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of files that one task reads.
TASK_BYTES = 64 * 1024 * 1024


def dealt(rows: DataFrame, n: int, total_bytes: int, *keys: str) -> DataFrame:
    """``n`` groups of rows that stand for ``total_bytes`` of files, dealt to a stated number of tasks.

    The rows themselves are small, so their own size says nothing about a task's work.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, 4 * cores), -(-total_bytes // TASK_BYTES)), *keys)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component: the least reachable node.

    Alternates large-star and small-star contraction (Kiveris et al., 2014): every
    round re-hangs neighbours below the least node seen, so the number of rounds is
    logarithmic in practice and no task ever holds a whole component.  A small-star step comes
    first: where a node has many links, as one in many buckets has, their far ends hang below the
    least of them from then on, and few links are left.  Links are never broadcast: Parquet packs
    them so well that their files say little about their size.  Self links and null ends are ignored;
    an empty table gives an empty table.
    """

    def hung(links: DataFrame) -> DataFrame:
        """Of links to smaller nodes, every node's own and its other ends' to the least of them."""
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

    def contracted(links: DataFrame) -> DataFrame:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return hung(both.join(low.hint("merge"), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first())

    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    links = materialise(hung(links), "links")
    before = state(links)
    while True:
        links = materialise(contracted(links), "links")
        now = state(links)
        if now == before:
            break
        before = now
    low = links.groupBy("a").agg(F.min("b").alias("b"))
    roots = low.select("b").distinct()
    return low.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


@contextmanager
def reading(uri: str):
    """A file of the shared folder, opened in a task for reading at any place."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        yield f


def store(uri: str, data: Iterator[bytes]) -> None:
    """Write a file under another name and move it into place, so that a repeated task leaves one whole file."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with fs.open_output_stream(part, compression=None) as f:
        for chunk in data:
            f.write(chunk)
    fs.move(part, path)
