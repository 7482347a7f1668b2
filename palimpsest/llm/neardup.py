"""N-gram Jaccard join by signature trees, and the classes of near copies it gives.

A document is its set of hashed word n-grams; documents of equal sets are one set. Sets whose Jaccard
similarity reaches ``threshold`` are found in three steps.

1. Routing. Two sets as similar as the threshold share at least that part of the n-grams of each. A rank
   is given to every n-gram: the number of texts that have it, then the least label of these. Of its n-grams
   that other texts have too, a set goes to the buckets of those that enough others of its own, of this
   rank or higher, stand beside; a bucket is a least label. The shared n-gram of lowest rank is such a one in
   both sets, so every pair meets, whatever its similarity above the threshold. A set too
   few of whose n-grams are in other texts goes nowhere, and a bucket of one set is dropped. To count, n-grams
   are dealt to ranges by chunks of texts, as arrays; only counts and labels come back.
2. Signature trees. In a bucket the sets, by size, are leaves of a tree whose nodes hold the OR of their
   512-bit token bitmaps, the range of their sizes, and the most tokens by which a set exceeds
   its bits. Traversing the tree against itself, a pair of nodes is dropped when
   ``min(sizes, common bits + excess)``, the most tokens that any of their sets can share, is too few for
   the threshold. The same bound then drops pairs of sets. It never drops a true pair. A pair
   that meets in several buckets is made one afterwards.
   A bucket of more than ``BLOCK`` sets is cut to blocks, and every pair of blocks is a cell of its own,
   of two trees, that any task can take.
3. Verification on the sets themselves. A pair is verified at the smallest set near it (the smaller of the
   smallest neighbours of the two), so a group of copies meets in one place, to which each text is
   sent once or a few times, however many pairs it is in. A place of many n-grams is cut to cells of pairs
   of blocks too. Dense cells are counted by matrix product.

No number of partners or candidates is capped. Sets are compared once, however many documents have them,
and what ``classes`` returns is one row a document: links are counted where they are verified. The work
still grows with the number of links between different texts, each of which is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.names import fresh, named
from palimpsest.llm.tokens import U64, Tokens, gram_hash, mix, tokenised, windows
from palimpsest.storage import removed, ship, written

GRAM, THRESHOLD = 3, 0.5
WORDS = 8  # of 64 bits, of a bitmap
LEAF = 16
#: Sets of a block of a bucket: two blocks meet in one task.
BLOCK = 2048
#: n-grams of a block of a place, and the least that a text counts as.
PLACE_GRAMS, LEAST_GRAMS = 1_000_000, 400
#: Pairs of leaves whose sets are compared at a time.
SLICE = 1024
#: n-grams of a chunk of texts, and about as many of a range.
CHUNK_GRAMS, PART_GRAMS = 2_000_000, 2_000_000
_DOC_BITS = U64(20)
#: A rank is a count in the upper 16 bits, at most 65,535, and a label.
_LABEL = U64(48)
_DEALT = "part int, chunk long, kind int, a binary, b binary, c binary"


def gram_sets(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(44-bit hashes, offsets by text) of the distinct n-grams of each text, sorted; a text of fewer
    than n tokens has one gram, of all its tokens."""
    at, doc = windows(t, n)
    g = gram_hash(t.hash, n)[at]
    m = np.diff(t.first)
    (short,) = np.nonzero((m > 0) & (m < n))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.array([mix(np.add.reduce(t.hash[t.first[k] : t.first[k + 1]] * (np.arange(m[k], dtype=U64) * U64(2) + U64(3))) + U64(m[k])) for k in short], U64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    keys = (doc.astype(U64) << (U64(64) - _DOC_BITS)) | (g >> _DOC_BITS)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    ends = np.searchsorted(keys >> (U64(64) - _DOC_BITS), np.arange(len(m) + 1, dtype=U64))
    return keys & ((U64(1) << (U64(64) - _DOC_BITS)) - U64(1)), ends.astype(np.int64)


def set_hashes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each non-empty set, whatever its order."""
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(g), first[:-1]) + np.diff(first).astype(U64)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, n-grams, sizes) of the texts that have any, of about a megabyte at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, _, t in tokenised(batch.column(1)):
            g, ends = gram_sets(t, gram)
            size = np.diff(ends)
            (some,) = np.nonzero(size)
            if len(some):
                yield ids[i + some], g, size[some]


def _first(size: np.ndarray) -> np.ndarray:
    """Offsets from 0 of runs of these sizes."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)])


def sketches(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    for ids, g, size in _sets(batches, gram):
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(set_hashes(g, _first(size))), pa.array(size.astype(np.int32))], ["doc_id", "set", "n"])


def _rows(part: list, chunk: list, kind: int, *blobs: list) -> pa.RecordBatch:
    cols = [pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.array([kind] * len(part), pa.int32()), *(pa.array([x.tobytes() for x in b], pa.binary()) for b in blobs)]
    return pa.RecordBatch.from_arrays(cols, ["part", "chunk", "kind", "a", "b", "c"])


def dealt(batches: Iterator[pa.RecordBatch], gram: int, parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to those of chunks: of kind 0 (sets, sizes, bitmaps of tokens), one a chunk, and of kind 1
    (texts, how many n-grams of each, lower 32 bits of these), one for each range of n-grams.

    A chunk has at most ``most`` n-grams or is about a megabyte of text, and is named by what is in it. Texts are counted from 0 in it.
    """

    def chunk(ids: np.ndarray, g: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = set_hashes(g, _first(size))
        text = np.repeat(np.arange(len(size), dtype=np.uint32), size)
        with np.errstate(over="ignore"):
            name = int(np.add.reduce(mix(mix(ids.view(U64)) + sets.view(U64) + np.arange(len(ids), dtype=U64))).view(np.int64))
        bits = np.zeros((len(size), WORDS * 64), bool)
        bits[text, (g & U64(WORDS * 64 - 1)).astype(np.int64)] = True
        yield _rows([name % parts], [name], 0, [sets], [size.astype(np.int32)], [np.packbits(bits, axis=1)])
        part = (((g >> U64(28)) * U64(parts)) >> U64(16)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, text, low = part[order], text[order], g[order].astype(np.uint32)
        run = _starts([part, text])
        count = np.diff(np.append(run, len(text))).astype(np.uint32)
        new = _starts([part])
        at = np.append(np.searchsorted(run, new), len(run))
        new_end = np.append(new, len(part))
        text = text[run]
        for k in range(0, len(new), 512):
            some = range(k, min(k + 512, len(new)))
            yield _rows(part[new[k : k + 512]].tolist(), [name] * len(some), 1, [text[at[x] : at[x + 1]] for x in some], [count[at[x] : at[x + 1]] for x in some], [low[new_end[x] : new_end[x + 1]] for x in some])

    held, grams = [], 0
    for ids, g, size in _sets(batches, gram):
        if held and grams + len(g) > most:
            yield from chunk(*(np.concatenate(x) for x in zip(*held)))
            held, grams = [], 0
        held.append((ids, g, size))
        grams += len(g)
    if held:
        yield from chunk(*(np.concatenate(x) for x in zip(*held)))


def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``dealt`` in order of part: kind 0 as they are, of kind 1 (texts, how many n-grams, their rank), of n-grams in several texts.

    n-grams of a range whose lower 32 bits are equal count as one: they share a rank, which loses no pair.
    """

    def judged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, chunks = rows[0][0], np.array([r[1] for r in rows], np.int64)
        texts, counts, low = ([np.frombuffer(r[k], np.uint32) for r in rows] for k in (2, 3, 4))
        first = _first(np.array([len(x) for x in texts]))
        text, count = np.concatenate(texts), np.concatenate(counts)
        with np.errstate(over="ignore"):
            label = mix(np.repeat(chunks.view(U64), np.diff(first)) + mix(text.astype(U64))) >> (U64(64) - _LABEL)
        keys = (np.concatenate(low).astype(U64) << U64(32)) | np.repeat(np.arange(len(text), dtype=U64), count)
        keys.sort()
        entry, keys = (keys & U64(0xFFFFFFFF)).astype(np.int64), keys >> U64(32)
        run = _starts([keys])
        df = np.diff(np.append(run, len(keys)))
        rank = (np.minimum(df, 65_535).astype(U64) << _LABEL) | np.minimum.reduceat(label[entry], run)
        some = np.repeat(df > 1, df)
        entry, rank = entry[some], np.repeat(rank[df > 1], df[df > 1])
        order = np.lexsort((rank, entry))
        entry, rank = entry[order], rank[order]
        run = _starts([entry, rank])
        many = np.diff(np.append(run, len(entry))).astype(np.uint32)
        entry, rank = entry[run], rank[run]
        cut = np.searchsorted(entry, first)
        full = np.nonzero(np.diff(cut))[0].tolist()
        if full:
            at = [slice(cut[r], cut[r + 1]) for r in full]
            yield _rows([part] * len(full), chunks[full].tolist(), 1, [text[entry[x]] for x in at], [many[x] for x in at], [rank[x] for x in at])

    rows: list[tuple] = []
    for batch in batches:
        kind = batch["kind"].to_numpy()
        if not kind.all():
            yield batch.filter(pa.array(kind == 0))
        part, chunk, blobs = batch["part"].to_pylist(), batch["chunk"].to_pylist(), [batch[c] for c in "abc"]
        for r in np.nonzero(kind)[0].tolist():
            if rows and rows[0][0] != part[r]:
                yield from judged(rows)
                rows = []
            rows.append((part[r], chunk[r], *(b[r].as_py() for b in blobs)))
    if rows:
        yield from judged(rows)


def routes(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows of ``ranked`` in order of (chunk, kind) to the buckets of sets, (key, set, n, bits)."""

    def judged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sets, n = np.frombuffer(rows[0][2], np.int64), np.frombuffer(rows[0][3], np.int32)
        rest = [r for r in rows if r[1]]
        if not rest:
            return
        text, many, rank = (np.concatenate([np.frombuffer(r[k], t) for r in rest]) for k, t in ((2, np.uint32), (3, np.uint32), (4, U64)))
        need = np.maximum(np.ceil(threshold * n - 1e-9), 1)
        ok = (np.bincount(text, many, len(n)) >= need)[text]
        text, many, rank = text[ok], many[ok].astype(np.int64), rank[ok]
        if not len(text):
            return
        order = np.lexsort((rank, text))
        text, rank = text[order], rank[order]
        run = _starts([text, rank])
        many, text, rank = np.add.reduceat(many[order], run), text[run], rank[run]
        before = _first(many)
        ends = np.append(_starts([text])[1:], len(text))
        ok = np.repeat(before[ends], np.diff(np.append(0, ends))) - before[:-1] >= need[text]  # those of this rank or higher
        text, key = text[ok], rank[ok] & ((U64(1) << _LABEL) - U64(1))
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        run = _starts([text, key])
        text, key = text[run], key[run]
        width = WORDS * 8
        bits = [rows[0][4][x * width : (x + 1) * width] for x in text.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sets[text]), pa.array(n[text]), pa.array(bits, pa.binary())], ["key", "set", "n", "bits"])

    here, rows = None, []
    for batch in batches:
        chunk, kind, blobs = batch["chunk"].to_pylist(), batch["kind"].to_pylist(), [batch[c] for c in "abc"]
        for r in range(len(batch)):
            if chunk[r] != here:
                if rows:
                    yield from judged(rows)
                here, rows = chunk[r], []
            rows.append((chunk[r], kind[r], *(b[r].as_py() for b in blobs)))
    if rows:
        yield from judged(rows)


def _may_share(n_a, n_b, excess_a, excess_b, common):
    return np.minimum(np.minimum(n_a, n_b), common + np.minimum(excess_a, excess_b))


class Tree:
    """A signature tree over sets in order of size: level 0 the leaves, LEAF sets each, then pairs of nodes."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(1)
        at = np.arange(0, len(n), LEAF)
        self.levels = [(np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.maximum.reduceat(excess, at))]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(lo), 2)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def leaf_pairs(self, share: float, other: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that the dual traversal leaves over: of this tree and another, or of this one, the first not after the second."""
        mine, theirs = self.levels, (other or self).levels
        p = q = np.zeros(1, np.int64)
        i, j = len(mine) - 1, len(theirs) - 1
        while True:
            (b, lo, hi, ex), (b2, lo2, hi2, ex2) = mine[i], theirs[j]
            common = np.bitwise_count(b[p] & b2[q]).sum(1)
            ok = _may_share(hi[p], hi2[q], ex[p], ex2[q], common) >= share * (lo[p] + lo2[q])
            p, q = p[ok], q[ok]
            if not (i or j):
                return p, q
            down = (i >= j, j >= i)  # the taller tree goes down by itself
            if all(down):
                p, q = np.concatenate([2 * p + k for k in (0, 0, 1, 1)]), np.concatenate([2 * q + k for k in (0, 1, 0, 1)])
            elif down[0]:
                p, q = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([q, q])
            else:
                p, q = np.concatenate([p, p]), np.concatenate([2 * q, 2 * q + 1])
            i, j = i - down[0], j - down[1]
            ok = (p < len(mine[i][1])) & (q < len(theirs[j][1]))
            if other is None:
                ok &= p <= q
            p, q = p[ok], q[ok]


def bucket_pairs(n: np.ndarray, bits: np.ndarray, share: float, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket, in order of size, that may reach the threshold, so many at a time.

    split: the first row of a second block; then pairs of a row of the first and one of the second.
    """
    if split is None and len(n) <= LEAF:
        yield np.triu_indices(len(n), 1)
        return
    if split is None:
        (p, q), base, top = Tree(n, bits).leaf_pairs(share), 0, len(n)
    else:
        if not 0 < split < len(n):
            return
        (p, q), base, top = Tree(n[:split], bits[:split]).leaf_pairs(share, Tree(n[split:], bits[split:])), split, split
    a, b = np.repeat(np.arange(LEAF), LEAF), np.tile(np.arange(LEAF), LEAF)
    for k in range(0, len(p), SLICE):
        i = (p[k : k + SLICE, None] * LEAF + a).ravel()
        j = (base + q[k : k + SLICE, None] * LEAF + b).ravel()
        ok = (i < top) & (j < len(n)) & (i < j)
        yield i[ok], j[ok]


def _kept(i, j, n, bits, share):
    excess = n - np.bitwise_count(bits).sum(1)
    common = np.bitwise_count(bits[i] & bits[j]).sum(1)
    ok = _may_share(n[i], n[j], excess[i], excess[j], common) >= share * (n[i] + n[j])
    return i[ok], j[ok]


def _starts(cols: list[np.ndarray]) -> np.ndarray:
    """Where runs of rows that are equal in all columns begin."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def bucket_join(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, ci, cj, block, set, n, bits) in order of (key, ci, cj, block, n) to pairs of sets."""

    def cells(t: pa.Table) -> np.ndarray:
        return _starts([t[c].to_numpy() for c in ("key", "ci", "cj")])

    def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
        start = cells(t)
        size = np.diff(np.append(start, len(t)))
        if size.max(initial=0) < 2:
            return
        sets, n = t["set"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        ci, cj, block = (t[c].to_numpy() for c in ("ci", "cj", "block"))
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), U64).reshape(-1, WORDS)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            own = ci[start] == cj[start]
            for m in range(2, LEAF + 1):  # all small buckets of a size at once
                (same,) = np.nonzero((size == m) & own)
                i, j = np.triu_indices(m, 1)
                step = max(1, (1 << 18) // len(i))
                for c in range(0, len(same), step):
                    first = start[same[c : c + step]][:, None]
                    yield (first + i).ravel(), (first + j).ravel()
            for k in np.nonzero((size > LEAF) | ~own)[0]:
                a, b = start[k], start[k] + size[k]
                split = None if own[k] else int(np.searchsorted(block[a:b], cj[a]))
                for i, j in bucket_pairs(n[a:b], bits[a:b], share, split):
                    yield a + i, a + j

        for i, j in found():
            x, y = _kept(i, j, n, bits, share)
            for c in range(0, len(x), 1 << 16):
                s, r = sets[x[c : c + (1 << 16)]], sets[y[c : c + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, r)), pa.array(np.maximum(s, r))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < 40_000:
            continue
        t = pa.Table.from_batches(held)
        cut = int(cells(t)[-1])  # the last cell may go on
        if cut:
            yield from joined(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), len(t) - cut
    if held:
        yield from joined(pa.Table.from_batches(held))


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of the connected group of each of n nodes, over the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        while (root[root] != root).any():
            root = root[root]
        rest = root[i] != root[j]
        i, j = root[i[rest]], root[j[rest]]
    return root


def _verify(batches: Iterator[pa.RecordBatch], gram: int, threshold: float, counting: bool) -> Iterator[pa.RecordBatch]:
    """Rows (place, ci, cj, kind, set, other, doc_id, copies, text), the texts of a cell before its pairs, to verified pairs.

    counting: not the pairs, but the links of each set, (set, null, documents), and edges that hold each group
    together, (id, id, 0).
    """

    def judged(sets, ids, copies, grams, pairs) -> Iterator[pa.RecordBatch]:
        if len(sets) < 2 or not pairs:
            return
        s = np.array(sets, np.int64)  # in order
        a, b = (np.concatenate(x) for x in zip(*pairs))
        i, j = np.searchsorted(s, a), np.searchsorted(s, b)
        i, j = np.minimum(i, len(s) - 1), np.minimum(j, len(s) - 1)
        there = (s[i] == a) & (s[j] == b)
        i, j = i[there], j[there]
        if not len(i):
            return
        shared = _overlaps(grams, i, j)
        n = np.array([len(g) for g in grams], np.int64)
        jac = shared / (n[i] + n[j] - shared)
        ok = jac >= threshold
        i, j, jac = i[ok], j[ok], jac[ok]
        if not len(i):
            return
        doc, c = np.array(ids, np.int64), np.array(copies, np.int64)
        if not counting:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j])), pa.array(jac)], ["doc_a", "doc_b", "jaccard"])
            return
        links = np.bincount(i, c[j], len(s)).astype(np.int64) + np.bincount(j, c[i], len(s)).astype(np.int64)
        (some,) = np.nonzero(links)
        root = components(len(s), i, j)
        (far,) = np.nonzero(root != np.arange(len(s)))
        x = np.concatenate([s[some], doc[root[far]]])
        y = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(doc[far])])
        yield pa.RecordBatch.from_arrays([pa.array(x), y, pa.array(np.concatenate([links[some], np.zeros(len(far), np.int64)]))], ["a", "b", "links"])

    cell, sets, ids, copies, grams, pairs = None, [], [], [], [], []
    for batch in batches:
        cols = [batch[c].to_numpy() for c in ("place", "ci", "cj", "kind")]
        want, text = batch["set"].to_numpy(), batch["text"]
        other, docs, counts = (pa.compute.fill_null(batch[c], 0).to_numpy() for c in ("other", "doc_id", "copies"))
        own: dict[int, np.ndarray] = {}
        for i, j, t in tokenised(text):
            if not len(t.hash):
                continue
            g, ends = gram_sets(t, gram)
            (full,) = np.nonzero(np.diff(ends))
            got = set_hashes(g, np.append(ends[full], len(g)))
            for k in np.nonzero(got == want[i + full])[0].tolist():  # else another text of a repeated id
                own[i + int(full[k])] = g[ends[full[k]] : ends[full[k] + 1]].copy()
        start = _starts(cols)
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(batch)]):
            here = tuple(int(c[lo]) for c in cols[:3])
            if here != cell:
                yield from judged(sets, ids, copies, grams, pairs)
                cell, sets, ids, copies, grams, pairs = here, [], [], [], [], []
            if cols[3][lo]:
                pairs.append((want[lo:hi], other[lo:hi]))
                continue
            for r in range(lo, hi):
                if r in own and (not sets or sets[-1] != want[r]):  # else a repeated row
                    sets.append(int(want[r]))
                    ids.append(int(docs[r]))
                    copies.append(int(counts[r]))
                    grams.append(own[r])
    yield from judged(sets, ids, copies, grams, pairs)


def _overlaps(grams: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common grams of the pairs (i, j)."""
    if len(i) < 8 * len(grams):
        return np.array([len(np.intersect1d(grams[x], grams[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    doc = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, col, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    some = count[col] > 1
    doc, col = doc[some], (np.cumsum(count > 1) - 1)[col[some]]
    width, m = int((count > 1).sum()), len(grams)
    out = np.zeros(len(i), np.int64)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    rows = max(1, min(m, 4_000_000 // max(1, m)))  # of a block of the product
    step = max(1, min(width, 8_000_000 // max(1, m)))  # columns at a time
    for r in range(0, m, rows):
        mine = (i >= r) & (i < r + rows)
        if not mine.any():
            continue
        total = np.zeros((min(rows, m - r), m), np.float32)
        for c in range(0, width, step):
            lo, hi = np.searchsorted(col, [c, c + step])
            x = np.zeros((m, min(step, width - c)), np.float32)
            x[doc[lo:hi], col[lo:hi] - c] = 1
            total += x[r : r + rows] @ x.T
        out[mine] = total[i[mine] - r, j[mine]].astype(np.int64)
    return out


def _cells(block: str, blocks: str) -> Column:
    """The pairs of blocks, as (ci, cj) with ci <= cj, that one block is in."""
    return F.expr(f"transform(sequence(0, {blocks} - 1), o -> struct(least(o, {block}) as ci, greatest(o, {block}) as cj))")


def _block(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.col("blocks")).cast("int")


class Found:
    """The tables of a join, written to the shared folder: ``members`` (doc_id, set), ``sets`` (set, rep, copies) and, lazily, ``similar``."""

    def __init__(self, docs: DataFrame, threshold: float, gram: int, id_col: str, text_col: str, counting: bool):
        ship(docs.sparkSession)
        share = threshold / (1 + threshold) - 1e-9
        d = docs.where(named(id_col).isNotNull()).select(named(id_col).cast("long").alias("doc_id"), F.lower(named(text_col)).alias("text")).where("text is not null")
        known = written(d.mapInArrow(lambda b: sketches(b, gram), "doc_id long, set long, n int"), "sketches")
        self.members = known.select("doc_id", "set").distinct()
        self.sets = self.members.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        sizes = known.select("set", "n").distinct()

        grams = known.agg(F.sum("n")).first()[0] or 0
        parts = min(1 << 16, max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-grams // PART_GRAMS)))
        ranks = d.mapInArrow(lambda b: dealt(b, gram, parts, CHUNK_GRAMS), _DEALT).repartition("part").sortWithinPartitions("part").mapInArrow(ranked, _DEALT)
        routed = ranks.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(lambda b: routes(b, threshold), "key long, set long, n int, bits binary")
        routed = written(routed.groupBy("key", "set").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "routes")
        several = routed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        routed = routed.join(several, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", _block("set"))
        routed = routed.select("*", F.inline(_cells("block", "blocks"))).repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "block", "n", "set")
        pairs = written(routed.select("key", "ci", "cj", "block", "set", "n", "bits").mapInArrow(lambda b: bucket_join(b, share), "a long, b long").distinct(), "candidates")

        both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("least"))
        placed = pairs.join(least.withColumnsRenamed({"x": "a", "least": "la"}), "a").join(least.withColumnsRenamed({"x": "b", "least": "lb"}), "b")
        placed = placed.select(F.least("la", "lb").alias("place"), "a", "b")
        sent = placed.select("place", F.col("a").alias("set")).union(placed.select("place", "b")).distinct()
        sent = sent.join(self.sets, "set").join(sizes, "set")
        blocks = sent.groupBy("place").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_GRAMS))) / PLACE_GRAMS).cast("int").alias("blocks"))
        sent = sent.join(blocks, "place").select("place", "set", F.col("rep").alias("doc_id"), "copies", "blocks", _block("set").alias("block"))
        texts = d.join(sent.hint("shuffle_hash"), "doc_id").select("place", F.inline(_cells("block", "blocks")), F.lit(0).alias("kind"), "set", F.lit(None).cast("long").alias("other"), "doc_id", "copies", "text")
        met = placed.join(blocks, "place").select("place", "a", "b", _block("a").alias("x"), _block("b").alias("y"))
        met = met.select("place", F.least("x", "y").alias("ci"), F.greatest("x", "y").alias("cj"), F.lit(1).alias("kind"), F.col("a").alias("set"), F.col("b").alias("other"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"))
        work = texts.union(met).repartition("place", "ci", "cj").sortWithinPartitions("place", "ci", "cj", "kind", "set")
        out = "a long, b long, links long" if counting else "doc_a long, doc_b long, jaccard double"
        self.similar = work.mapInArrow(lambda b: _verify(b, gram, threshold, counting), out)


def join(docs: DataFrame, *, threshold: float = THRESHOLD, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b: pairs between representatives, and membership.

    The documents of one set are represented by their smallest id; sets as similar as the threshold are
    pairs of representatives, and another document of a set is in one pair, with its representative, at 1.0.
    A text with at least one token but fewer than ``gram`` is one gram; null and empty texts are similar to
    nothing. Rows without an id are left out; ids are whole numbers. A repeated row counts once; of an id with
    several texts each text is compared, and pairs of an id with itself aren't reported. Texts may be of any
    length. Other columns are ignored, whatever their names; an empty table gives no pairs.
    """
    f = Found(docs, threshold, gram, id_col, text_col, counting=False)
    equal = f.members.join(f.sets.where("copies > 1"), "set").where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return f.similar.where("doc_a <> doc_b").union(equal.distinct())


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of, n_copies, n_links): one row for each document that has a copy or near copy.

    ``class_id`` is the smallest id of its connected group of near copies, ``copy_of`` the smallest id of the
    documents with the same n-grams (its own, if it is the first), ``n_copies`` the number of others of these,
    ``n_links`` the number of documents of other n-grams that are as similar as the threshold.
    Nulls, empty, long and short texts and repeated rows are as in ``join``; an id with several texts is one
    document, whose links are added up. A document that is similar to none has no row.
    """
    f = Found(docs, threshold, gram, id_col, text_col, counting=True)
    similar = written(f.similar, "links")
    links = similar.where("b is null").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    of = f.members.join(f.sets, "set").join(links, "set", "left").select("doc_id", "rep", F.col("copies") - 1, F.coalesce("links", F.lit(0)).alias("links")).toDF("doc_id", "rep", "copies", "links")
    of = written(of.where("copies > 0 or links > 0"), "documents")  # few: those that have a copy, once a text
    # an id with several texts is tied to the representative of each, and joins their groups
    edges = similar.where("b is not null").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).union(of.where("rep <> doc_id").select("rep", "doc_id"))
    of = of.groupBy("doc_id").agg(F.min("rep").alias("copy_of"), F.sum("copies").alias("n_copies"), F.sum("links").alias("n_links"))
    roots = groups_of(edges)
    return of.join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), "copy_of", "n_copies", "n_links")


def groups_of(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the smallest id of the connected group of each document in a pair.

    Alternating large-star and small-star passes; every pass is written to the shared folder. The
    number of passes grows with the logarithm of a group's diameter.
    """
    now = written(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        new = written(small, "edges")
        removed(now)
        now = new
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that a smaller id of their class of near copies stands for.

    Rows with a null id stay, as do null and empty texts. Rows that repeat an id are one document and
    stay or go together. Texts may be of any length, and extra columns stay, whatever their names.
    """
    id_col = options.get("id_col", "doc_id")
    own = fresh("gone", docs)
    gone = classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(own))
    return docs.join(gone, named(id_col) == F.col(own), "left_anti")
