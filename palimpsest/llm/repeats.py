"""Suffix-array dedup: passages that several documents share, by merged Burrows-Wheeler transforms.

A passage repeats if all of a run of ``depth`` tokens occurs in documents of at least two ids.

1. Anchors. The anchor of a run of ``depth`` tokens is its smallest hash of ``GRAM`` tokens, the first of
   ties, so equal runs have equal anchors wherever they stand. Successive runs that share an anchor are
   one context. Only (anchor, hash of the context, id, position) is shuffled; anchors that
   documents of one id only have can't be in a repeated run, and go. Nothing that repeats is lost.
2. A context that several documents have as a whole repeats as a whole. Where an anchor has several
   contexts, the tokens of one copy of each are fetched.
3. Merge. Contexts are gathered by anchor; each shard of them gets its own Burrows-Wheeler transform. The
   transforms are merged by iterative interleave refinement: beginning with the transforms one after another,
   each pass takes every row of the current interleave to the row of the suffix one token
   longer, a stable distribution by that token, so after h passes suffixes are in order of their
   first h tokens and the boundaries between blocks are where common prefixes are shorter than h.
   The pass in which a boundary comes up is the common prefix. After ``depth`` passes the blocks are the
   repeated intervals. Suffixes are never sorted again across shards; a suffix alone in its block stays
   alone with any tokens before it, so it is left out of later passes.

No number of copies or contexts is capped, and no text is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.names import named
from palimpsest.llm.tokens import U64, Tokens, mix, powers, tokenised
from palimpsest.storage import ship, written

DEPTH, GRAM = 50, 16
#: Tokens of a shard, whose suffixes are sorted together before shards are merged.
SHARD = 1 << 16
#: Rows that are handled at a time, besides those of the last anchor.
ROWS = 20_000
_P = 0x9E3779B97F4A7C15 | 1
OUT = "doc_id long, token_from int, token_to int, first boolean"


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n tokens, n a power of two: each doubling joins two halves."""
    g, m = h, 1
    with np.errstate(over="ignore"):
        while m < n:
            g = g[:-m] * U64(pow(_P, m, 1 << 64)) + g[m:]
            m *= 2
    return mix(g)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w successive values."""
    m = 1
    while 2 * m <= w:
        v = np.minimum(v[:-m], v[m:])
        m *= 2
    return np.minimum(v[: len(v) - (w - m)], v[w - m :]) if w > m else v


def contexts_of(t: Tokens, depth: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, context, first token of the first run, runs) of each context of a group of texts."""
    none = np.empty(0, np.int64)
    if len(t.hash) < depth:
        return none, none, none, none, none
    doc = t.doc
    g = _grams(t.hash, gram)
    w = depth - gram + 1
    if len(g) < 1 << 24:
        at = _least((g & ~U64((1 << 24) - 1)) | np.arange(len(g), dtype=U64), w)
        at = (at & U64((1 << 24) - 1)).astype(np.int64)
    else:  # one text of over 16 million tokens: in parts that overlap
        at = np.concatenate([_anchor_at(g[k : k + (1 << 23) + w - 1], w) + k for k in range(0, len(g) - w + 1, 1 << 23)])
    run = np.arange(len(at))
    inside = doc[: len(at)] == doc[depth - 1 : depth - 1 + len(at)]
    run, at = run[inside], at[inside]
    if not len(run):
        return none, none, none, none, none
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (run[1:] != run[:-1] + 1)])
    (lead,) = np.nonzero(new)
    runs = np.diff(np.concatenate([lead, [len(run)]]))
    start = run[lead]
    return doc[start], g[at[lead]].view(np.int64), content(t.hash, start, start + runs + depth - 1), start - t.first[doc[start]], runs


def _anchor_at(g: np.ndarray, w: int) -> np.ndarray:
    return (_least((g & ~U64((1 << 24) - 1)) | np.arange(len(g), dtype=U64), w) & U64((1 << 24) - 1)).astype(np.int64)


def content(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the tokens [start, end) wherever they stand."""
    p, inv = powers(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h) * p[: len(h)], dtype=U64)])
        return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64)).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, _, t in tokenised(batch.column(1)):
            doc, anchor, context, start, runs = contexts_of(t, depth)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(ids[i + doc]), pa.array(start.astype(np.int32)), pa.array(runs.astype(np.int16))], ["h", "ctx", "doc_id", "start", "n"])


def _by_anchor(batches: Iterator[pa.RecordBatch], use: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``use`` on tables of whole groups of equal ``h``, of rows in order of it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < ROWS or held[0]["h"][0] == batch["h"][len(batch) - 1]:
            continue
        t = pa.Table.from_batches(held)
        h = t["h"].to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        yield from use(t.slice(0, cut).combine_chunks())
        held, rows = t.slice(cut).to_batches(), len(t) - cut
    if held:
        yield from use(pa.Table.from_batches(held).combine_chunks())


def _starts(*cols: np.ndarray) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _sift(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, doc_id, start, n), in order, of anchors that documents of several ids have, with what is
    known of the context: the smallest and largest id, whether it is its anchor's only one, and its first row."""
    h, ctx, doc = (t[c].to_numpy() for c in ("h", "ctx", "doc_id"))
    new_c, new_h = _starts(h, ctx), _starts(h)
    (at_c,), (at_h,) = np.nonzero(new_c), np.nonzero(new_h)
    lo, hi = doc[at_c], doc[np.concatenate([at_c[1:], [len(doc)]]) - 1]
    c_of_h = np.searchsorted(at_c, at_h)
    several = np.minimum.reduceat(lo, c_of_h) != np.maximum.reduceat(hi, c_of_h)
    alone = np.diff(np.concatenate([c_of_h, [len(at_c)]])) == 1
    c, k = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
    (keep,) = np.nonzero(several[k])
    if len(keep):
        part = t.take(pa.array(keep))
        cols = [*(part[x].combine_chunks() for x in ("h", "ctx", "doc_id", "start", "n")), pa.array(lo[c[keep]]), pa.array(hi[c[keep]]), pa.array(alone[k[keep]]), pa.array(new_c[keep])]
        yield pa.RecordBatch.from_arrays(cols, ["h", "ctx", "doc_id", "start", "n", "lo", "hi", "alone", "lead"])


def _fetched(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted contexts) to the contexts with their tokens."""
    for batch in batches:
        wanted = batch.column("wanted")
        flat, offs = wanted.flatten(), wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        h, ctx, start, n, lo, hi = (flat.field(k).to_numpy() for k in range(6))
        for i, j, t in tokenised(batch.column("text")):
            a, b = offs[i], offs[j]
            row = np.repeat(np.arange(j - i), np.diff(offs[i : j + 1]))
            at = start[a:b] + t.first[row]
            end = at + n[a:b] + depth - 1
            (ok,) = np.nonzero(end <= t.first[row + 1])
            ok = ok[content(t.hash, at[ok], end[ok]) == ctx[a:b][ok]]  # else another text of the same id
            if len(ok):
                tokens = [t.hash[x:y].tobytes() for x, y in zip(at[ok].tolist(), end[ok].tolist())]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[a:b][ok]) for c in (h, ctx, n, lo, hi)), pa.array(tokens, pa.binary())], ["h", "ctx", "n", "lo", "hi", "tokens"])


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, row of the suffix one symbol longer) of strings that each end with symbol 0.

    Suffixes are ordered by their first ``depth`` symbols, ties by position; the row before a whole string
    is -1. The order is found by doubling.
    """
    n = len(text)
    rank, m = text.astype(np.int64), 1
    ends = np.nonzero(text == 0)[0]
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end
    rank = np.where(left == 0, 0, rank)
    while m < min(depth, n):
        other = np.zeros(n, np.int64)
        other[: n - m] = rank[m:] + 1
        other[left < m] = 0
        key = rank * (int(rank.max(initial=0)) + int(other.max(initial=0)) + 2) + other
        _, rank = np.unique(key, return_inverse=True)
        m *= 2
    order = np.argsort(rank, kind="stable")
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    begins = order == 0
    begins[order > 0] = text[order[order > 0] - 1] == 0
    bwt = np.where(begins, 0, text[order - 1])
    return bwt, np.where(begins, -1, row[order - 1])


def merged(shards: list[np.ndarray], depth: int, prune: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, block starts, common prefixes) of suffixes in order of their first ``depth`` symbols.

    Positions are into the shards one after another. With ``prune`` only suffixes of at least ``depth``
    symbols that share these with another are left over, and common prefixes are empty; without, all
    suffixes are there, with the symbols (at most depth - 1) each has in common with the one before.
    """
    bwts, rows, places, base = [], [], [], 0
    for s in shards:
        b, r = transform(s, depth)
        place = np.empty(len(s), np.int64)
        # the suffix of row r begins at place[r]: follow each string back from its end
        ends = np.nonzero(s == 0)[0]
        place[_rows_of_positions(r, ends, len(s))] = np.arange(len(s))
        bwts.append(b)
        rows.append(np.where(r < 0, -1, r + base))
        places.append(place + base)
        base += len(s)
    bwt, longer, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (bwts, rows, places))
    bwt = bwt.astype(np.uint16 if bwt.max(initial=0) < 1 << 16 else np.int64)  # 16 bits are distributed by radix
    text = np.concatenate(shards) if shards else np.empty(0, np.int64)
    now, block = np.arange(len(bwt)), np.zeros(len(bwt), np.int64)
    empty = np.argsort(place, kind="stable")[text == 0]  # rows of the empty suffixes, which never move
    lcp = np.full(0 if prune else len(bwt), -1)
    for h in range(1, depth + 1):
        c = bwt[now]
        (go,) = np.nonzero(c)
        c = c[go]
        go = go[np.argsort(c, kind="stable")]
        c, was = bwt[now[go]], block[go]
        new = _starts(c, was)
        now = longer[now[go]]
        if prune:
            many = ~(new & np.append(new[1:], True))
            now, block = now[many], np.cumsum(new[many])
            if not len(now):
                break
        else:
            now = np.concatenate([empty, now])
            new = np.concatenate([np.ones(len(empty), bool), new])
            block = np.cumsum(new)
            lcp[new & (lcp < 0)] = h - 1
    if not len(now):
        return now, np.empty(0, bool), lcp
    return place[now], _starts(block), np.where(lcp < 0, depth, lcp)


def _rows_of_positions(longer: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Row of the suffix at each position: the empty suffixes are the first rows, in order of position."""
    out = np.empty(n, np.int64)
    at, row = ends.copy(), np.arange(len(ends))
    while len(at):
        out[at] = row
        row = longer[row]
        more = row >= 0
        at, row = at[more] - 1, row[more]
    return out


def _judged(t: pa.Table, depth: int) -> Iterator[pa.RecordBatch]:
    """Contexts to bits of the runs that repeat, and of those of which their smallest id has the first copy."""
    h, ctx = t["h"].to_numpy(), t["ctx"].to_numpy()
    t = t.take(pa.array(np.nonzero(_starts(h, ctx))[0]))
    n, lo, hi = t["n"].to_numpy().astype(np.int64), t["lo"].to_numpy(), t["hi"].to_numpy()
    size = n + depth - 1
    tokens = np.frombuffer(b"".join(t["tokens"].to_pylist()), U64)
    _, symbol = np.unique(tokens, return_inverse=True)
    ends = np.cumsum(size + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = symbol + 1
    cuts = np.unique(np.searchsorted(ends, np.arange(SHARD, int(ends[-1]) + SHARD, SHARD)))
    shards = np.split(text, np.unique(ends[cuts[cuts < len(ends) - 1]])) if len(ends) > 1 else [text]
    at, new, _ = merged(shards, depth)
    repeats, first = np.zeros(len(n), U64), np.zeros(len(n), U64)
    whole = lo != hi  # all runs of a context that several documents have
    ones = (U64(1) << n.astype(U64)) - U64(1)
    repeats[whole] = ones[whole]
    first[:] = ones
    if len(at):
        c = np.searchsorted(ends, at, "right")
        bit = U64(1) << (at - np.concatenate([[0], ends[:-1]])[c]).astype(U64)
        (lead,) = np.nonzero(new)
        block = np.cumsum(new) - 1
        low, high = np.minimum.reduceat(lo[c], lead)[block], np.maximum.reduceat(hi[c], lead)[block]
        several = low != high
        np.bitwise_or.at(repeats, c[several], bit[several])
        late = lo[c] != low
        np.bitwise_and.at(first, c[late], ~bit[late])
    yield pa.RecordBatch.from_arrays([t["h"].combine_chunks(), t["ctx"].combine_chunks(), pa.array(repeats.view(np.int64)), pa.array(first.view(np.int64))], ["h", "ctx", "repeats", "firsts"])


def _spans(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (h = id, start, n, repeats, firsts) in order of id to maximal spans of tokens."""

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, start, n = t["h"].to_numpy(), t["start"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        bits = [(t[c].to_numpy().view(U64)[row] >> k.astype(U64)) & U64(1) != 0 for c in ("repeats", "firsts")]
        ok = bits[0]
        doc, at, first = doc[row][ok], (start[row] + k)[ok], bits[1][ok]
        if not len(doc):
            return
        o = np.lexsort((at, first, doc))
        doc, at, first = doc[o], at[o], first[o]
        new = _starts(doc, first)
        new[1:] |= at[1:] > at[:-1] + depth  # spans that touch are one
        (lead,) = np.nonzero(new)
        last = np.concatenate([lead[1:], [len(at)]]) - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[lead]), pa.array(at[lead].astype(np.int32)), pa.array((at[last] + depth).astype(np.int32)), pa.array(first[lead])], ["doc_id", "token_from", "token_to", "first"])

    return _by_anchor(batches, of)


def repeated(docs: DataFrame, *, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_from, token_to, first): the spans of tokens that other documents have too.

    A span is the union of touching runs of ``depth`` tokens (from GRAM + 1 to GRAM + 63). ``first`` tells
    those whose smallest id is the document's own from those that an earlier document has; of a
    document all spans that aren't first can be cut, and each passage is kept once.

    Rows with a null id are left out; null and empty texts, and those of fewer than ``depth`` tokens,
    have no spans. A passage that only one id has is no repeat, however often it has it, so repeated
    rows change nothing; of an id with several texts each is searched, and their spans are put
    together. Texts may be of any length; ids are whole numbers. Other columns are ignored, whatever their
    names; an empty table gives an empty result. Shards are slices of the contexts that one task merges.
    """
    if not GRAM < depth < GRAM + 64:
        raise ValueError(f"depth must be from {GRAM + 1} to {GRAM + 63}")
    ship(docs.sparkSession)
    d = docs.where(named(id_col).isNotNull() & named(text_col).isNotNull()).select(named(id_col).cast("long").alias("doc_id"), F.lower(named(text_col)).alias("text"))
    anchors = d.mapInArrow(lambda b: _anchors(b, depth), "h long, ctx long, doc_id long, start int, n short")
    anchors = anchors.repartition("h").sortWithinPartitions("h", "ctx", "doc_id", "start")
    known = written(anchors.mapInArrow(lambda b: _by_anchor(b, _sift), "h long, ctx long, doc_id long, start int, n short, lo long, hi long, alone boolean, lead boolean"), "anchors")

    wanted = known.where("lead and not alone").groupBy("doc_id").agg(F.collect_list(F.struct("h", "ctx", "start", "n", "lo", "hi")).alias("wanted"))
    tokens = d.join(wanted.hint("shuffle_hash"), "doc_id").select("text", "wanted").mapInArrow(lambda b: _fetched(b, depth), "h long, ctx long, n short, lo long, hi long, tokens binary")
    tokens = tokens.repartition("h").sortWithinPartitions("h", "ctx")
    judged = tokens.mapInArrow(lambda b: _by_anchor(b, lambda t: _judged(t, depth)), "h long, ctx long, repeats long, firsts long")

    own = F.col("doc_id") == F.col("lo")
    whole = F.lit(-1).cast("long")
    certain = known.where("alone").select("doc_id", "start", "n", whole.alias("repeats"), F.when(own, whole).otherwise(0).alias("firsts"))
    other = known.where("not alone").join(judged, ["h", "ctx"]).where("repeats <> 0").select("doc_id", "start", "n", "repeats", F.when(own, F.col("firsts")).otherwise(0).alias("firsts"))
    runs = certain.union(other).withColumnRenamed("doc_id", "h").repartition("h").sortWithinPartitions("h", "start")
    return runs.mapInArrow(lambda b: _spans(b, depth), OUT)
