"""Merkle trees over ordered leaves: root, inclusion and consistency proofs.

Leaves and nodes are hashed under different prefixes; of n leaves the left subtree takes the largest power of
two below n. That is the tree that pairing neighbours and promoting a lone last node gives, so a distributed
root hashes aligned blocks of 2**k leaves first, then their roots, until one is left. A root is sealed with the
number of its leaves, so that no proof can claim another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import removed, ship, written

BLOCK_BITS = 12
#: Leaf hashes of a row of what is written: workers get rows by the thousand.
ROW = 64


def leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + data).digest()


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def fold(hashes: list[bytes]) -> bytes:
    """The root over leaf hashes."""
    level = hashes or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        odd = [level[-1]] if len(level) % 2 else []
        level = [node(a, b) for a, b in zip(level[::2], level[1::2])] + odd
    return level[0]


def seal(tree: bytes, n: int) -> bytes:
    return hashlib.sha256(b"\x02" + n.to_bytes(8, "little") + tree).digest()


def sealed(hashes: list[bytes]) -> bytes:
    return seal(fold(hashes), len(hashes))


def _split(n: int) -> int:
    return 1 << ((n - 1).bit_length() - 1)


def spine(hashes: list[bytes]) -> list[bytes]:
    """Roots of the whole subtrees of n leaves, the largest first: one for each bit of n."""
    out, at = [], 0
    for k in range(len(hashes).bit_length() - 1, -1, -1):
        if len(hashes) >> k & 1:
            out.append(fold(hashes[at : at + (1 << k)]))
            at += 1 << k
    return out


def appended(parts: list[bytes], n: int, leaf_hash: bytes) -> list[bytes]:
    """The spine after one more leaf."""
    out, h = list(parts), leaf_hash
    while n & 1:
        h = node(out.pop(), h)
        n >>= 1
    return [*out, h]


def spine_root(parts: list[bytes]) -> bytes:
    """The tree of a spine."""
    if not parts:
        return fold([])
    h = parts[-1]
    for left in reversed(parts[:-1]):
        h = node(left, h)
    return h


def inclusion(hashes: list[bytes], i: int) -> list[bytes]:
    """Sibling hashes from leaf i up."""
    n = len(hashes)
    if n == 1:
        return []
    k = _split(n)
    if i < k:
        return [*inclusion(hashes[:k], i), fold(hashes[k:])]
    return [*inclusion(hashes[k:], i - k), fold(hashes[:k])]


def included(root: bytes, leaf_hash: bytes, i: int, n: int, path: list[bytes]) -> bool:
    """Whether the path leads from leaf i of n to the sealed root."""

    def up(i: int, n: int, path: list[bytes]) -> bytes | None:
        if n == 1:
            return leaf_hash if not path else None
        if not path:
            return None
        k = _split(n)
        below = up(i, k, path[:-1]) if i < k else up(i - k, n - k, path[:-1])
        return None if below is None else node(below, path[-1]) if i < k else node(path[-1], below)

    if not 0 <= i < n:
        return False
    tree = up(i, n, path)
    return tree is not None and seal(tree, n) == root


def consistency(hashes: list[bytes], m: int) -> list[bytes]:
    """Proof that the first m leaves' tree is a prefix of the whole: the old tree first."""

    def part(h: list[bytes], m: int, whole: bool) -> list[bytes]:
        n = len(h)
        if m == n:
            return [] if whole else [fold(h)]
        k = _split(n)
        if m <= k:
            return [*part(h[:k], m, whole), fold(h[k:])]
        return [*part(h[k:], m - k, False), fold(h[:k])]

    return [fold(hashes[:m]), *part(hashes, m, True)]


def consistent(old: bytes, m: int, new: bytes, n: int, proof: list[bytes]) -> bool:
    """Whether the proof leads from the sealed root of m leaves to that of n."""
    if not proof or not 0 < m <= n or seal(proof[0], m) != old:
        return False
    was, *rest = proof

    def part(m: int, n: int, whole: bool) -> tuple[bytes, bytes]:
        """(old tree, new tree) of a subtree, from the proof's end."""
        if m == n:
            h = was if whole else rest.pop(0)
            return h, h
        k = _split(n)
        if m <= k:
            a, b = part(m, k, whole)
            return a, node(b, rest.pop(0))
        a, b = part(m - k, n - k, False)
        left = rest.pop(0)
        return node(left, a), node(left, b)

    try:
        a, b = part(m, n, True)
    except IndexError:
        return False
    return a == was and seal(b, n) == new and not rest


def root(rows: DataFrame, order: str | list[str], data: Column | str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(root, n): the sealed root over ``data``, in order of ``order``.

    Ranges of the order are sorted where they are and their leaves hashed: 32 bytes a leaf are all that is
    written. Once the sizes of the ranges are known, each folds the blocks of 2**block_bits leaves that lie
    within it; what is left at its ends meets the rest of its block, and the roots of the blocks are folded in
    the same way until one is left.
    """
    spark = rows.sparkSession
    ship(spark)
    by, content = [order] if isinstance(order, str) else order, F.col(data) if isinstance(data, str) else data
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), content.cast("binary").alias("d"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            h = [hashlib.sha256(b"\x00" + (d or b"")).digest() for d in b.column("d").to_pylist()]
            cuts = range(0, len(h), ROW)
            yield pa.RecordBatch.from_arrays([b.column("part").slice(0, len(cuts)), pa.array([at + k for k in cuts], pa.int64()), pa.array([b"".join(h[k : k + ROW]) for k in cuts], pa.binary())], ["part", "at", "hashes"])
            at += len(h)

    level = written(ranged.mapInArrow(leaves, "part int, at long, hashes binary").where("length(hashes) > 0"), "leaves")
    sizes = {r[0]: r[1] for r in level.groupBy("part").agg((F.sum(F.length("hashes")) / 32).cast("long")).collect()}  # a row a range
    starts, n = {}, 0
    for p in sorted(sizes):
        starts[p] = n
        n += sizes[p]
    if not n:
        removed(level)
        return spark.createDataFrame([(sealed([]).hex(), 0)], "root string, n long")
    offsets = spark.createDataFrame(list(starts.items()), "part int, start long")
    size = 1 << block_bits
    runs = level.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("at")).alias("at"), "hashes")
    count = n
    while True:
        parts = runs.mapInArrow(lambda b: _blocks(b, size), "block long, at long, hashes binary, whole boolean")
        parts = written(parts, "merkle")
        removed(level)
        level = parts
        count = (count + size - 1) // size
        whole = parts.where("whole").select("block", F.col("hashes").alias("h"))
        loose = parts.where("not whole").groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.hex("hashes").alias("x")))), lambda s: s["x"]), "").alias("x"))

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [fold([x[k : k + 32] for k in range(0, len(x), 32)]) for x in map(bytes.fromhex, b.column("x").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(got, pa.binary())], ["block", "h"])

        roots = whole.union(loose.mapInArrow(folded, "block long, h binary"))
        if count <= size:
            tree = fold([bytes(r.h) for r in sorted(roots.collect(), key=lambda r: r.block)])  # 2**block_bits at most
            removed(level)
            return spark.createDataFrame([(seal(tree, n).hex(), n)], "root string, n long")
        runs = roots.select(F.col("block").alias("at"), F.col("h").alias("hashes"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs (at, hashes) of successive nodes, put together and cut at multiples of ``size``: whole blocks folded, the others as they are.

    One block at most is held, and what is given out comes a block at a time.
    """
    start, run = 0, bytearray()

    def done() -> pa.RecordBatch:
        full = len(run) == 32 * size
        out = fold([bytes(run[k : k + 32]) for k in range(0, len(run), 32)]) if full else bytes(run)
        return pa.RecordBatch.from_arrays([pa.array([start // size]), pa.array([start]), pa.array([out], pa.binary()), pa.array([full])], ["block", "at", "hashes", "whole"])

    for b in batches:
        for at, h in zip(b.column("at"), b.column("hashes")):
            at, h = at.as_py(), h.as_py()
            if run and at != start + len(run) // 32:
                yield done()
                run.clear()
            while h:
                if not run:
                    start = at
                take = 32 * ((at // size + 1) * size - at)
                run += h[:take]
                at, h = at + len(h[:take]) // 32, h[take:]
                if at % size == 0:
                    yield done()
                    run.clear()
    if run:
        yield done()
