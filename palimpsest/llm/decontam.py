"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a mask over successive tokens of which only the marked positions are hashed, so a
window still matches where substituted tokens fall on the ignored positions. Every window of every
document, under every mask, is looked up among those of the benchmark. A hit names an item and a
diagonal (document position minus item position); hits of one diagonal are verified together on the
tokens themselves. An overlap is a stretch that begins and ends with equal tokens, has ``min_tokens`` tokens
(or is the whole of a shorter item) and ``min_ratio`` of them equal. The best-scoring one is taken, with +1 for
an equal and -2 for a substituted token, or if that is none the longest, and then the same on either side of it,
so that every overlap of a diagonal is reported or meets one that is.

The benchmark side is fitted to memory by a checked size. Up to ``broadcast_windows`` windows (16
bytes each, counted before) its hashes go to every worker as a sorted array and a document is never
shuffled. Beyond that, window hashes of documents are thinned by a Bloom filter of bounded size and joined
with the benchmark's by a shuffle; the diagonals that hit are gathered by document, with the texts of its
items, and verified in one pass over the document: same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.names import fresh, named
from palimpsest.llm.tokens import U64, Tokens, mix, tokenised
from palimpsest.storage import ship, written

#: Weight 8, over 8 to 13 tokens: contiguous, and three that let substitutions by.
MASKS = ("11111111", "1101100111011", "1110010110111", "111011010011")
MIN_TOKENS, MIN_RATIO = 13, 0.8
#: Benchmark windows that are sent to every worker; 16 bytes each, so 16 MB. A worker holds a table of 64 to 128 MB beside them.
BROADCAST_WINDOWS = 1_000_000
#: Most bits of the Bloom filter of the way beyond (64 MB). It has 16 a window up to there; beyond, more windows pass it and are joined.
BLOOM_BITS = 1 << 29
_ODD = U64(0x9E3779B97F4A7C15)
OUT = "doc_id long, item_id long, doc_from long, doc_to long, item_from int, item_to int, n_equal int, ratio double"


def seed_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash under the mask of the window that begins at each token, while it fits."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        x = np.full(m, U64(salt + 1))
        for k, c in enumerate(mask):
            if c == "1":
                x *= _ODD
                x += h[k : k + m]
    return mix(x)


def _short_masks(masks: tuple[str, ...], n: int) -> list[str]:
    """Masks for an item of n tokens; one shorter than every mask is hashed as a whole."""
    fit = [m for m in masks if len(m) <= n]
    return fit or (["1" * n] if n >= 4 else [])


class Index:
    """The benchmark's tokens, and its windows sorted by hash, as arrays that pickle well."""

    def __init__(self, items: np.ndarray, texts: pa.Array, masks: tuple[str, ...] = MASKS, search: bool = True):
        hashes, firsts, ids = [], [0], []
        for i, j, t in tokenised(texts):
            hashes.append(t.hash)
            firsts.extend((firsts[-1] + t.first[1:]).tolist())
            ids.extend(items[i:j].tolist())
        self.tokens = np.concatenate(hashes) if hashes else np.empty(0, U64)
        self.first, self.ids = np.array(firsts, np.int64), np.array(ids, np.int64)
        if not search:
            return
        self.masks: list[str] = list(masks)
        keys, at = [], []
        for k, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
            for m in _short_masks(masks, int(b - a)):
                if m not in self.masks:
                    self.masks.append(m)
                s = seed_hashes(self.tokens[a:b], m, len(m) if m not in masks else self.masks.index(m))
                keys.append(s)
                at.append(np.stack([np.full(len(s), k), np.arange(len(s))], 1).astype(np.int32))
        self.salts = [len(m) if m not in masks else i for i, m in enumerate(self.masks)]
        keys = np.concatenate(keys) if keys else np.empty(0, U64)
        at = np.concatenate(at) if at else np.empty((0, 2), np.int32)
        o = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[o], at[o]
        self._mark()

    def _mark(self) -> None:
        """A table of 64 entries a key or more: most windows of a document are turned away by one look-up."""
        keys = self.keys
        self.bits = np.zeros(1 << max(16, int(len(keys) * 64 - 1).bit_length() if len(keys) else 16), bool)
        self.bits[(self.keys & U64(len(self.bits) - 1)).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "bits"}  # made again where it arrives

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if "keys" in state:
            self._mark()

    def hits(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, item's number, item position) of each hit of windows that stay in one text."""
        out = []
        for m, salt in zip(self.masks, self.salts):
            s = seed_hashes(h, m, salt)
            if not len(s) or not len(self.keys):
                continue
            (p,) = np.nonzero(self.bits[(s & U64(len(self.bits) - 1)).astype(np.int64)])
            p = p[doc[p] == doc[p + len(m) - 1]]
            lo = np.searchsorted(self.keys, s[p], "left")
            n = np.searchsorted(self.keys, s[p], "right") - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            if len(p):
                k = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                out.append((np.repeat(p, n), self.at[k, 0], self.at[k, 1]))
        if not out:
            z = np.empty(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))  # type: ignore[return-value]


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """[from, to) of the largest sum of +1 (equal) and -2 (not), the first and then longest of ties."""
    s = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(s)
    gain = s - low
    to = int(np.argmax(gain))
    start = int(np.nonzero(s[: to + 1] == low[to])[0][0])
    return start, to


def longest_stretch(equal: np.ndarray, min_ratio: float) -> tuple[int, int]:
    """[from, to) of the longest stretch between equal tokens of which ``min_ratio`` are equal, the first of ties."""
    (at,) = np.nonzero(equal)
    if not len(at):
        return 0, 0
    k = np.arange(len(at))
    before, after = k - min_ratio * at, k + 1 - min_ratio * (at + 1)
    start = np.searchsorted(-np.minimum.accumulate(before), -(after + 1e-9))  # the first that isn't above
    best = int(np.argmax(at - at[start]))
    return int(at[start[best]]), int(at[best]) + 1


def stretches(equal: np.ndarray, least: int, min_ratio: float) -> list[tuple[int, int]]:
    """Disjoint stretches, in order, of ``least`` tokens or more with ``min_ratio`` of them equal."""
    out, todo = [], [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        part = equal[lo:hi]
        if hi - lo < least or part.sum() < min_ratio * least - 1e-9:
            continue
        s, t = best_stretch(part)
        if t - s < least or part[s:t].sum() < min_ratio * (t - s) - 1e-9:
            s, t = longest_stretch(part, min_ratio)
        if t - s >= max(1, least):
            out.append((lo + s, lo + t))
            todo += [(lo, lo + s), (lo + t, hi)]
    return sorted(out)


def seeded(equal: np.ndarray, masks: list[str]) -> bool:
    """Whether a window of a diagonal is equal at all marked positions of a mask."""
    for m in masks:
        n = len(equal) - len(m) + 1
        if n > 0 and np.logical_and.reduce([equal[k : k + n] for k, c in enumerate(m) if c == "1"]).any():
            return True
    return False


def verified(ix: Index, h: np.ndarray, first: int, last: int, item: int, diagonal: int, min_tokens: int, min_ratio: float, masks: tuple[str, ...] = ()) -> list[tuple]:
    """(doc token from, to, item from, to, equal tokens) of the overlaps on a diagonal; with masks, of one that has a hit."""
    a, b = int(ix.first[item]), int(ix.first[item + 1])
    lo, hi = max(0, first - diagonal), min(b - a, last - diagonal)
    if hi <= lo:
        return []
    equal = h[diagonal + lo : diagonal + hi] == ix.tokens[a + lo : a + hi]
    if masks and not seeded(equal, _short_masks(masks, b - a)):
        return []
    found = stretches(equal, min(min_tokens, b - a), min_ratio)
    return [(diagonal + lo + s, diagonal + lo + t, lo + s, lo + t, int(equal[s:t].sum())) for s, t in found]


def overlaps(ix: Index, t: Tokens, min_tokens: int, min_ratio: float) -> list[tuple]:
    """(text, item's number, doc from, doc to, item from, item to, equal) of a group of texts."""
    doc = t.doc
    p, item, q = ix.hits(t.hash, doc)
    if not len(p):
        return []
    out, found = [], {}
    for i, d in np.unique(np.stack([item, p - q], 1), axis=0).tolist():
        # one diagonal can lie in several texts
        mine = np.unique(doc[p[(item == i) & (p - q == d)]]) if len(p) < 64 else None
        if mine is None:
            mine = found.setdefault("by", _texts(item, p - q, doc[p]))[(i, d)]
        for k in mine:
            first, last = int(t.first[k]), int(t.first[k + 1])
            for got in verified(ix, t.hash, first, last, i, d, min_tokens, min_ratio):
                out.append((int(k), i, got[0] - first, got[1] - first, *got[2:]))
    return sorted(set(out))


def _texts(item: np.ndarray, diagonal: np.ndarray, doc: np.ndarray) -> dict:
    by: dict = {}
    for i, d, k in set(zip(item.tolist(), diagonal.tolist(), doc.tolist())):
        by.setdefault((i, d), []).append(k)
    return by


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    masks: tuple[str, ...] = MASKS,
    min_tokens: int = MIN_TOKENS,
    min_ratio: float = MIN_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row for each verified overlap of a document with a benchmark item (schema ``OUT``).

    Positions count tokens. A null or empty text on either side gives nothing, and neither does an
    item of fewer than 4 tokens. Texts may be of any length. A document without an id can't be named and is
    left out, as is an item without one; ids are whole numbers. Repeated rows give repeated rows of documents,
    and once for repeated items. Either table may be empty. Other columns are ignored. Which way is taken
    changes no row.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.where(named(id_col).isNotNull()).select(named(id_col).cast("long").alias("doc_id"), F.lower(named(text_col)).alias("text"))
    b = _items(benchmark, item_col, text_col)
    windows = windows_of(b, masks)
    if windows > broadcast_windows:
        return _shuffled(d, b, windows, masks, min_tokens, min_ratio)
    shared = spark.sparkContext.broadcast(_index(b, masks))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), []
            for i, _, t in tokenised(batch.column(1)):
                rows += [(int(ids[i + k]), *r) for k, *r in overlaps(ix, t, min_tokens, min_ratio)]
            if rows:
                yield _batch(rows, ix)

    return d.mapInArrow(scan, OUT)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    b = benchmark.where(named(item_col).isNotNull() & named(text_col).isNotNull())
    return b.select(named(item_col).cast("long").alias("item_id"), F.lower(named(text_col)).alias("text")).distinct()


def windows_of(b: DataFrame, masks: tuple[str, ...]) -> int:
    """The windows that the benchmark has under all masks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(max(0, int(k) - len(m) + 1) for _, _, t in tokenised(batch.column(0)) for k in np.diff(t.first) for m in _short_masks(masks, int(k)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return b.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def _index(b: DataFrame, masks: tuple[str, ...]) -> Index:
    table = b.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    return Index(table["item_id"].to_numpy(), table["text"].combine_chunks(), masks)


def _batch(rows: list[tuple], ix: Index, key: pa.DataType = pa.int64()) -> pa.RecordBatch:
    c = list(zip(*rows))
    ratio = [n / max(1, b - a) for a, b, n in zip(c[2], c[3], c[6])]
    kinds = (key, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    cols = (c[0], ix.ids[list(c[1])].tolist(), c[2], c[3], c[4], c[5], c[6], ratio)
    names = [x.split()[0] for x in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names)


def _window_rows(masks: tuple[str, ...], bloom=None):
    """mapInArrow function: (id, h, first token) of the windows, of a document those that the filter lets by."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value if bloom is not None else None
        for batch in batches:
            ids = batch.column(0)
            for i, _, t in tokenised(batch.column(1)):
                doc, lens = t.doc, np.diff(t.first)
                wanted = {m: k for k, m in enumerate(masks)}
                if bits is None:
                    for n in np.unique(lens):
                        wanted |= {m: len(m) for m in _short_masks(masks, int(n)) if m not in masks}
                else:
                    wanted |= {"1" * n: n for n in range(4, min(map(len, masks)))}
                for m, salt in wanted.items():
                    s = seed_hashes(t.hash, m, salt)
                    p = np.arange(len(s))
                    p = p[doc[p] == doc[p + len(m) - 1]] if len(s) else p
                    if bits is None and m not in masks:
                        p = p[lens[doc[p]] == len(m)]
                    elif bits is not None:
                        p = p[_in_bloom(bits, s[p])]
                    if len(p):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + doc[p])), pa.array(s[p].view(np.int64)), pa.array(p - t.first[doc[p]])], ["id", "h", "at"])

    return emit


def _in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & U64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _hits(d: DataFrame, b: DataFrame, windows: int, masks: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, item_id, diagonals) of windows in common, by a shuffle, and the benchmark as it was written."""
    b = written(b, "bench")
    bench = written(b.mapInArrow(_window_rows(masks), "item_id long, h long, q long"), "bench-windows")
    size = min(BLOOM_BITS, max(1 << 20, 1 << int(16 * windows).bit_length()))

    def fill(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(U64) & U64(size - 1)
            np.bitwise_or.at(bits, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()])], ["bits"])

    merged = np.zeros(size // 8, np.uint8)
    for part in bench.select("h").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        merged |= np.frombuffer(bytes(part[0]), np.uint8)
    bloom = d.sparkSession.sparkContext.broadcast(merged)  # BLOOM_BITS / 8 bytes at most
    ours = d.mapInArrow(_window_rows(masks, bloom), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, h long, p long")
    found = ours.join(bench, "h").groupBy("doc_id", "item_id").agg(F.collect_set(F.col("p") - F.col("q")).alias("diagonals"))
    return found, b


def _shuffled(d: DataFrame, b: DataFrame, windows: int, masks: tuple[str, ...], min_tokens: int, min_ratio: float) -> DataFrame:
    """The way beyond the broadcast: hashes joined by a shuffle, then every document with its items brought together."""
    found, b = _hits(d, b, windows, masks)
    wanted = found.join(b, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonals", "text")).alias("items"))
    both = d.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items = batch.column("doc_id"), batch.column("items")
            for i, j, t in tokenised(batch.column("text")):
                for k in range(j - i):
                    mine = items[i + k].values
                    ix = Index(mine.field("item_id").to_numpy(), mine.field("text"), masks, search=False)
                    first, last = int(t.first[k]), int(t.first[k + 1])
                    rows = set()
                    for item, diagonals in enumerate(mine.field("diagonals").to_pylist()):
                        for x in diagonals:  # of an id with several texts, one text's hits are not another's
                            for got in verified(ix, t.hash, first, last, item, first + x, min_tokens, min_ratio, masks):
                                rows.add((docs[i + k].as_py(), item, got[0] - first, got[1] - first, *got[2:]))
                    if rows:
                        yield _batch(sorted(rows), ix, docs.type)

    return both.mapInArrow(verify, OUT.replace("doc_id long", f"doc_id {d.schema['doc_id'].dataType.simpleString()}"))


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    masks: tuple[str, ...] = MASKS,
    min_tokens: int = MIN_TOKENS,
    min_ratio: float = MIN_RATIO,
    text_col: str = "text",
    item_col: str = "item_id",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The rows of ``docs`` in the text of which no benchmark item is found.

    Every row is judged by its own text, whatever its id, which may be null or repeated: equal texts stay
    or go together. A row with a null, empty or too short text is kept. Texts may be of any length; all
    columns are kept, whatever their names. An empty benchmark drops nothing. Up to ``broadcast_windows``
    nothing is shuffled; beyond, texts are named by their SHA-256 and leaking ones removed by an anti-join,
    with the same rows.
    """
    spark = docs.sparkSession
    ship(spark)
    b = _items(benchmark, item_col, text_col)
    windows = windows_of(b, masks)
    if windows > broadcast_windows:
        sha, own = F.sha2(F.coalesce(named(text_col), F.lit("")).cast("binary"), 256), fresh("sha", docs)
        texts = docs.where(named(text_col).isNotNull()).select(sha.alias("doc_id"), F.lower(named(text_col)).alias("text"))
        bad = _shuffled(texts, b, windows, masks, min_tokens, min_ratio).select(F.col("doc_id").alias(own)).distinct()
        return docs.join(bad, sha == F.col(own), "left_anti")
    shared = spark.sparkContext.broadcast(_index(b, masks))

    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), bool)
        for i, _, t in tokenised(texts):
            for row in overlaps(shared.value, t, min_tokens, min_ratio):
                found[i + row[0]] = True
        return pa.array(found)

    return docs.where(~leaks(F.lower(F.coalesce(named(text_col), F.lit("")))))
