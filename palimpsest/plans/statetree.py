"""The tree over a state's entries: canonical nodes, root, membership and non-membership proofs.

Entries (key, value hash) in order of the key's bytes are cut to leaves after every key whose level is above 0,
leaves to branches after every key whose level is above 1, and so on, until one node is left. The level of a key is
a function of the key alone, so the tree is that of the key set, however it came about. A node's hash covers its
entries, a branch's entries are the last keys and hashes of its children: a path from the root to a leaf proves
that a key is there with a value, or that it isn't.

A large state's leaves are cut where its sorted ranges are; only the run that a range leaves open at either
end is put together with its neighbours'. The nodes above, one for some 32 entries, are cut on the driver once
they are few, and in the same way before.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import removed, ship, written

BITS, MOST = 5, 16
#: Nodes of a level that the driver cuts.
FEW = 100_000
Entry = tuple[bytes, str]


def level_of(key: bytes) -> int:
    h = int.from_bytes(hashlib.sha256(key).digest(), "big")
    return min((256 - h.bit_length()) // BITS, MOST)


def value_hash(value: bytes) -> str:
    return hashlib.sha256(b"blob:" + value).hexdigest()


def node_hash(level: int, entries: list[Entry]) -> str:
    """Entries are written as hexadecimal keys and hashes, a line each, under the level."""
    lines = "".join(f"{k.hex()}:{h}\n" for k, h in entries)
    return hashlib.sha256(f"node:{level}\n{lines}".encode()).hexdigest()


def cut(entries: list[Entry], level: int) -> list[list[Entry]]:
    """Nodes of a level."""
    out: list[list[Entry]] = []
    now: list[Entry] = []
    for e in entries:
        now.append(e)
        if level_of(e[0]) > level:
            out.append(now)
            now = []
    return [*out, now] if now else out


EMPTY = hashlib.sha256(b"node:empty").hexdigest()


class Tree:
    """All nodes of a small state, or of the upper levels of a large one."""

    def __init__(self, entries: list[Entry], level: int = 0):
        self.nodes: dict[str, tuple[int, list[Entry]]] = {}
        while True:
            nodes = cut(entries, level)
            entries = []
            for n in nodes:
                h = node_hash(level, n)
                self.nodes[h] = (level, n)
                entries.append((n[-1][0], h))
            if len(entries) <= 1:
                break
            level += 1
        self.root = entries[0][1] if entries else EMPTY

    def path(self, key: bytes) -> list[tuple[int, list[Entry]]]:
        """Nodes from the root to the leaf in which the key would be."""
        out, h = [], self.root
        while h in self.nodes:
            out.append(self.nodes[h])
            level, entries = self.nodes[h]
            if level == 0:
                break
            h = entries[routed(entries, key)][1]
        return out


def routed(entries: list[Entry], key: bytes) -> int:
    return min(bisect_left([k for k, _ in entries], key), len(entries) - 1)


def proof(tree: Tree, key: bytes) -> dict:
    """{path: [[level, [[key, hash]]]], found: hash or None} as plain values."""
    path = tree.path(key)
    found = dict(path[-1][1]).get(key) if path and path[-1][0] == 0 else None
    return {"path": [[level, [[k.hex(), h] for k, h in entries]] for level, entries in path], "found": found}


def proves(root: str, key: bytes, given: dict) -> bool:
    """Whether the proof, on the root's word alone, shows that the key has the value hash ``found``, or if that is None isn't there."""
    try:
        path = [(int(level), [(bytes.fromhex(k), str(h)) for k, h in entries]) for level, entries in given["path"]]
        found = given["found"]
    except (KeyError, TypeError, ValueError):
        return False
    if not path:
        return root == EMPTY and found is None
    want = root
    for at, (level, entries) in enumerate(path):
        keys = [k for k, _ in entries]
        if not entries or node_hash(level, entries) != want or any(a >= b for a, b in zip(keys, keys[1:])):
            return False
        if (level == 0) != (at == len(path) - 1) or at and level != path[at - 1][0] - 1:
            return False
        if level == 0:
            return dict(entries).get(key) == found
        want = entries[routed(entries, key)][1]
    return False


def nodes_of(entries: DataFrame, level: int) -> DataFrame:
    """(key, hash) of the nodes of a level over entries (key binary, hash), each key once, distributed."""
    ship(entries.sparkSession)
    ranged = entries.select("key", "hash").repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole nodes with their hash; what is open at the beginning (side 0) and end (side 1) of a range with its entries."""
        first, now = True, []
        part = None
        for b in batches:
            out = []
            part = b.column("part")[0].as_py()
            for k, h in zip(b.column("key").to_pylist(), b.column("hash").to_pylist()):
                now.append((k, h))
                if level_of(k) > level:
                    out.append((part, 0, k, None, _lines(now)) if first else (part, 2, k, node_hash(level, now), None))
                    first, now = False, []
            if out:
                yield _batch(out)
        if now:
            yield _batch([(part, 0 if first else 1, now[-1][0], None, _lines(now))])

    kept = written(ranged.mapInArrow(ends, "part int, side int, key binary, hash string, lines string"), "tree")
    whole = kept.where("side = 2").select("key", "hash")
    # ranges are few: an open run goes on until a range that has a key which ends it
    open_ = kept.where("side < 2").select("part", "side", "key", F.col("lines")).orderBy("part", "side").toLocalIterator()
    done, lines, last = [], "", None
    for r in open_:
        lines, last = lines + r.lines, bytes(r.key)
        if r.side == 0 and level_of(last) > level:
            done.append((bytearray(last), hashlib.sha256(f"node:{level}\n{lines}".encode()).hexdigest()))
            lines, last = "", None
    if last is not None:
        done.append((bytearray(last), hashlib.sha256(f"node:{level}\n{lines}".encode()).hexdigest()))
    out = written(whole.union(entries.sparkSession.createDataFrame(done, "key binary, hash string")), "tree-level")
    removed(kept)
    return out


def _lines(entries: list[Entry]) -> str:
    return "".join(f"{k.hex()}:{h}\n" for k, h in entries)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "side", "key", "hash", "lines"])


def root(state: DataFrame) -> str:
    """The root over (key, value), binary columns, of any size."""
    level, rows, old = 0, state.select("key", F.sha2(F.concat(F.lit(b"blob:"), F.col("value")), 256).alias("hash")), None
    while True:
        some = rows.limit(FEW + 1).collect()
        if len(some) <= FEW:
            if old is not None:
                removed(old)
            found = sorted((bytes(k), h) for k, h in some)
            return found[0][1] if level and len(found) == 1 else Tree(found, level).root
        rows = nodes_of(rows, level)
        if old is not None:
            removed(old)
        old, level = rows, level + 1
