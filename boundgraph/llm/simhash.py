"""SimHash near-dedup by pivot distance tables.

Every text becomes a fingerprint of ``64 * words`` bits.  For fixed reference
fingerprints (pivots) the Hamming distances of a fingerprint to them are computed
once.  By the triangle inequality two fingerprints that differ in ``d`` bits have
coordinates that differ by at most ``d``, so a pair whose largest coordinate
difference exceeds ``max_bits`` is discarded without being looked at; survivors are
verified bit by bit.

So that not all pairs have to meet, the pivots come in *tables*: the pivots of one
table differ from the zero fingerprint in that table's bits only.  Rows meet where
all relative distances of one table agree, which is to say where its bits agree.  Pivots
drawn at random could not choose candidates: their coordinates of any two fingerprints lie within
``max_bits`` = 3 of 64 almost half the time.  They discard what has met in a bucket.
When the bits are split into ``p`` disjoint parts and a table has all but ``max_bits`` of them, a pair
within ``max_bits`` agrees in at least one table: nothing is lost.  Drawn tables lose pairs
at a rate that follows from their number and width.  Both kinds get wider, and more, as
the number of fingerprints grows, so that a bucket holds about ``CROWD`` of unrelated ones at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialise, release

SEED = 42
#: Unrelated fingerprints that a bucket is to hold at most.
CROWD = 256
#: Fingerprints that one block of a bucket holds; a larger bucket is split into blocks that meet in pairs.
BLOCK = 2048
#: Shingles of a family of texts that one task holds against each other; a larger family is split like a bucket.
GRAMS = 1 << 18
#: Pairs that are looked at in one vectorised step.
STEP = 500_000


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """A further 64-bit hash from ``h``; the word 0 is ``h`` itself."""
    if word == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * word) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype="<u8")
    if len(tokens) < shingle:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=">u8").astype("<u8")


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> list[int]:
    """The fingerprint of one text as ``words`` unsigned 64-bit integers.

    Words are runs of bytes other than space and \\t..\\r after A-Z are lowered; each run
    of ``shingle`` words counts once per occurrence; a shorter text is one shingle.
    Null and wordless texts give zero.
    """
    return _bits(shingle_hashes(text, shingle), words)


def _bits(h: np.ndarray, words: int) -> list[int]:
    """The majority of every bit over hashes of shingles."""
    if not len(h):
        return [0] * words
    out = []
    for word in range(words):
        ones = np.zeros(64, dtype=np.int64)
        mixed = _mixed(h, word)
        for at in range(0, len(h), 65536):
            part = mixed[at : at + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """``(id, f0, f1, ...)``: the fingerprint words of every row as signed longs.

    With ``distinct`` a shingle counts once however often it is repeated, and two more columns
    ``s0, s1`` have a hash of the set of shingles.
    """
    names = [*(f"f{w}" for w in range(words)), *(("s0", "s1") if distinct else ())]

    def row(text: str | None) -> list[int]:
        h = shingle_hashes(text, shingle)
        if not distinct:
            return _bits(h, words)
        h = np.unique(h)
        whole = xxhash.xxh3_128_intdigest(h.tobytes(), SEED)
        return [*_bits(h, words), whole >> 64, whole % 2**64]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.array([row(t) for t in part.column(1).to_pylist()], dtype=np.uint64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(found[:, n]).view(np.int64)) for n in range(len(names)))], names=["id", *names])
        release()  # a task's memory goes back before the next stage needs it

    schema = "id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def table_width(n: int, least: int) -> int:
    """Bits that a table has to have for ``n`` fingerprints."""
    return max(least, int(np.ceil(np.log2(max(n, 2) / CROWD))))


def exact_tables(words: int, max_bits: int, n: int) -> list[list[int]]:
    """Tables that lose no pair within ``max_bits``: of the fewest parts that make them wide enough for ``n`` fingerprints, all but ``max_bits``."""
    bits, parts = 64 * words, max_bits + 1
    while parts < 3 * (max_bits + 1) and bits * (parts - max_bits) // parts < table_width(n, 1):
        parts += 1
    split = np.array_split(np.arange(bits), parts)
    return [sorted(np.concatenate(own).tolist()) for own in combinations(split, parts - max_bits)]


def drawn_tables(words: int, tables: int, width: int, apart: float, n: int) -> list[list[int]]:
    """Tables drawn at random with a fixed seed: ``tables`` of ``width`` bits, or, for many fingerprints, wider ones.

    Of wider ones there are as many more as keep the chance that a pair meets which differs in the share ``apart`` of all bits.
    """
    wide = table_width(n, width)
    missed = lambda bits: np.log1p(-((1 - apart) ** bits))
    rng = np.random.default_rng(SEED)
    return [sorted(rng.choice(64 * words, wide, replace=False).tolist()) for _ in range(int(np.ceil(tables * missed(width) / missed(wide))))]


def table_pivots(bits: list[int], words: int) -> np.ndarray:
    """The pivots of a table, one row of words each.

    For bits in fours, three pivots that share one bit: their distances tell apart
    fifteen of the sixteen patterns of the four.
    """
    out = []
    for at in range(0, len(bits), 4):
        four = bits[at : at + 4]
        for other in four[1:] or four:
            p = np.zeros(words, dtype=np.uint64)
            for bit in {four[0], other}:
                p[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
            out.append(p)
    return np.array(out)


def distances(f: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words to pivots: ``len(f)`` x ``len(pivots)``."""
    return sum(np.bitwise_count(f[:, None, w] ^ pivots[None, :, w]).astype(np.int16) for w in range(f.shape[1]))


def general_pivots(words: int, n: int = 8) -> np.ndarray:
    """Pivots drawn at random with a fixed seed, for discarding pairs within a bucket."""
    return np.random.default_rng(SEED + 1).integers(0, 2**64, size=(n, words), dtype=np.uint64)


def close_pairs(f: np.ndarray, group: np.ndarray, max_bits: int, pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of rows of the same ``group`` that differ in ``max_bits`` bits at most, and in how many.

    Rows are ordered by group and first coordinate, so each row meets only those
    whose first coordinate is within ``max_bits``; the other coordinates discard
    most of the rest before any pair is verified.
    """
    table = distances(f, pivots)
    line = group.astype(np.int64) * 4096 + table[:, 0]
    order = np.argsort(line, kind="stable")
    line, table, f = line[order], table[order], f[order]
    until = np.minimum(np.searchsorted(line, line + max_bits, side="right"), np.searchsorted(group[order], group[order], side="right"))
    n = until - np.arange(len(line)) - 1
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(line):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, side="right")) - 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], n[at:to])
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= max_bits
            i, j = i[near], j[near]
        apart = sum(np.bitwise_count(f[i, w] ^ f[j, w]).astype(np.int16) for w in range(f.shape[1]))
        near = apart <= max_bits
        yield order[i[near]], order[j[near]], apart[near]
        at = to


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` rows the least row that the pairs connect it with."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(nodes: DataFrame, max_bits: int, tables: list[list[int]], words: int = 1, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: of all links of at most ``max_bits``, such as connect the same nodes, one per row and block: to the least node there that it reaches.

    ``nodes(node, f0, ...)`` may have a fingerprint under several nodes.  A bucket holds the rows that
    agree in one pivot table; one with more than ``block`` rows is dealt by hash into
    blocks, and its blocks meet in pairs, so that no task gets a whole hot bucket.
    """
    names = [f"f{w}" for w in range(words)]
    own = [table_pivots(t, words) for t in tables]
    zero = np.zeros((1, words), dtype=np.uint64)
    general = general_pivots(words, 8 if max_bits < 8 * words else 1)  # beyond, they discard next to nothing

    def words_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = words_of(batch)
            base = distances(f, zero)
            for t, pivots in enumerate(own):
                digits = (distances(f, pivots) - base + 2) // 2  # -2, 0, 2: how the pivot's bits are set
                key = digits.astype(np.int64) @ (3 ** np.arange(len(pivots), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t, dtype=np.int32)), pa.array(key), batch.column("node"), *(batch.column(n) for n in names)], names=["t", "key", "node", *names])
        release()

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("node")
            group = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            f = np.stack([batch.column(n).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1)
            order = np.lexsort((ids, group))
            group, ids, f = group[order], ids[order], f[order]
            root = local_roots(len(ids), ((i, j) for i, j, _ in close_pairs(f, group, max_bits, general)))
            hung = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[hung], ids[root[hung]])), pa.array(np.minimum(ids[hung], ids[root[hung]]))], names=["a", "b"])
        release()

    typed = ", ".join(f"{n} long" for n in names)
    keyed = nodes.select("node", *names).mapInArrow(keys, f"t int, key long, node long, {typed}")
    sizes = keyed.groupBy("t", "key").count().where("count > 1")
    # Spark sizes ``keyed`` like ``nodes``, of which it has a row for every table: without the hint it would be broadcast where nodes are small.
    blocks = (
        keyed.join(sizes.hint("merge"), ["t", "key"])
        .withColumn("parts", F.ceil(F.col("count") / block))
        .withColumn("part", F.pmod(F.xxhash64(*names, "node"), F.col("parts")))
        .groupBy("t", "key", "parts", "part")
        .agg(F.collect_list(F.struct("node", *names)).alias("r"))
        .select("t", "key", "parts", "part", *(F.col(f"r.{n}").alias(n) for n in ["node", *names]))
    )
    lists = ["node", *names]
    alone = blocks.where("parts = 1").select(*lists)
    split = materialise(blocks.where("parts > 1"), "blocks")
    left, right = split.alias("l"), split.select("t", "key", "part", *lists).alias("r")
    met = left.join(right, (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.part") < F.col("r.part"))).select(*(F.concat(f"l.{n}", f"r.{n}").alias(n) for n in lists))
    return alone.union(met).mapInArrow(forest, "a long, b long").distinct()


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(id, family, grams)`` of ``texts(id, family, text)``: sorted hashes of the different shingles, as :func:`fingerprint` forms them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["id", "family", "grams"])
        release()

    return texts.select("id", "family", "text").mapInArrow(run, "id long, family long, grams array<long>")


def similar_links(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect all sets that pairs of a Jaccard similarity of ``similarity`` at least connect.

    ``flat`` has the sets one after the other.  A set that is reached is held against all that
    are not, so no pair that could still join two groups is left out.
    """
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    values, code = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    own = np.zeros(len(values), dtype=bool)
    rest = np.flatnonzero(sizes)
    codes, reached = code, []  # those of rest
    while len(rest):
        if not reached:
            reached, codes, rest = [rest[0]], codes[sizes[rest[0]] :], rest[1:]
            continue
        at = reached.pop()
        mine = code[ends[at] - sizes[at] : ends[at]]
        own[mine] = True
        n = sizes[rest]
        both = np.add.reduceat(own[codes], np.cumsum(n) - n, dtype=np.int64)
        own[mine] = False
        near = both >= similarity * (n + sizes[at] - both)
        if near.any():
            found = rest[near]
            a.append(found)
            b.append(np.full(len(found), at))
            reached += found.tolist()
            codes, rest = codes[np.repeat(~near, n)], rest[~near]
    return np.concatenate(a), np.concatenate(b)


def alike(found: DataFrame, docs: DataFrame, similarity: float, shingle: int, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links of a Jaccard similarity of ``similarity`` at least, by the texts' sets of shingles.

    The links ``found(a, b)`` only say which texts may be alike: those that they connect are a
    family, and within it all pairs count that could join two groups, so a link that fails
    hides no other.  A family of more than ``grams`` shingles or ``block`` texts is dealt by hash
    into parts that meet in pairs.  Of rows that share an id any may count.
    """
    families = connected_components(found).select(F.col("node").alias("id"), F.col("component").alias("family"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(families, "id").distinct()
    member = materialise(shingle_sets(texts, shingle), "shingles")
    parts = F.greatest(F.ceil(F.sum(F.size("grams")) / grams), F.ceil(F.count(F.lit(1)) / block))
    large = member.groupBy("family").agg(parts.alias("parts")).where("parts > 1")  # a row for so many shingles or texts
    blocks = (
        member.join(F.broadcast(large), "family", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        .groupBy("family", "parts", "part")
        .agg(F.collect_list(F.struct("id", "grams")).alias("r"))
        .select("family", "parts", "part", "r.id", "r.grams")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                ids = one.column("id").flatten().to_numpy(zero_copy_only=False)
                lists = one.column("grams").flatten()
                i, j = similar_links(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])
        release()

    alone = blocks.where("parts = 1").select("id", "grams")
    split = materialise(blocks.where("parts > 1"), "parts")
    left, right = split.alias("l"), split.alias("r")
    met = left.join(right, (F.col("l.family") == F.col("r.family")) & (F.col("l.part") < F.col("r.part"))).select(*(F.concat(f"l.{n}", f"r.{n}").alias(n) for n in ("id", "grams")))
    return alone.union(split.select("id", "grams")).union(met).mapInArrow(verify, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, max_bits: int = 3, tables: Callable[[int], list[list[int]]] | None = None, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, f0.., component)`` for every row: its fingerprint and the least id reachable by links.

    Two fingerprints are linked if they differ in ``max_bits`` bits at most.  Without
    ``tables``, which gives tables for a number of fingerprints, that is exact.  With ``similarity`` such links only name families of texts, and the links
    are those of texts of a family whose sets of shingles are as similar (Jaccard); fingerprints are
    then of the sets, and only texts of one set are copies unseen.

    * Null, empty and wordless texts have the fingerprint zero and link like any other.
    * Rows with a null id take part in no link; their component is null.
    * Repeated rows each give a row; rows that share an id are one document.
    * An empty table gives an empty table; further columns are ignored.
    """
    names = [f"f{w}" for w in range(words)]
    keys = names if similarity is None else [*names, "s0", "s1"]
    prints = materialise(fingerprints(docs, shingle, words, id_col, text_col, similarity is not None), "prints")
    nodes = materialise(prints.where("id is not null").groupBy(*keys).agg(F.min("id").alias("node")), "nodes")
    # One document may stand under two texts if its id is repeated: those fingerprints are one node.
    same = prints.where("id is not null").groupBy("id").agg(*(F.min(n).alias(f"lo{i}") for i, n in enumerate(keys)), *(F.max(n).alias(f"hi{i}") for i, n in enumerate(keys))).where(" or ".join(f"lo{i} <> hi{i}" for i in range(len(keys))))
    twice = prints.join(same.select("id"), "id", "left_semi").join(nodes.select("node", *keys), keys).select(F.col("id").alias("a"), F.col("node").alias("b"))
    n = nodes.count()
    linked = links(nodes, max_bits, tables(n) if tables else exact_tables(words, max_bits, n), words)
    if similarity is not None:
        linked = alike(materialise(linked, "links"), docs, similarity, shingle, id_col, text_col)
    found = connected_components(linked.union(twice))
    component = nodes.join(found, "node", "left").select(*keys, F.coalesce("component", "node").alias("component"))
    return prints.join(component, keys, "left").select("id", *names, F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
