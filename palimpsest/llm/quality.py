"""Quality classifier: a generalised additive model with pairwise interactions.

A text gets a fixed vector of features; every feature is cut into bins, and a model is one lookup
table by feature and one by chosen pair of features. A score is the sum of the entries that a
text's bins point at: a few vectorised additions. The tables are learned by cyclic boosting: round
after round each feature in turn gets one shallow tree fitted to the current gradients, shrunk and
added to its table; then the pairs whose coarse two-way histogram explains most of what is left
are boosted in the same way. Two models are trained, of quality and of toxicity.

Training sees at most ``max_rows`` labelled documents, those of the smallest hash of their id: half
of them give the word lists behind two of the features (by smoothed log odds), the other half the
tables. Everything else covers all documents, in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.names import fresh, named
from palimpsest.llm.tokens import Tokens, groups, tokenised
from palimpsest.storage import removed, ship, written

#: Labelled documents that training sees, whatever the size of the corpus.
MAX_ROWS = 12_000
#: Words of a learned list, and documents that a word must occur in to be on it.
LIST_WORDS, LIST_DOCS = 256, 4
BINS, PAIR_BINS, PAIRS = 32, 8, 6
NAMES = ("tokens", "token_bytes", "symbols", "pipes", "exclaims", "capitals", "digits", "newlines", "stops", "short", "distinct", "bad_words", "toxic_words", "toxic_count")

_CLASSES = (b"%$#&*@^~=<>{}[]\\/+_`", b"|", b"!?", bytes(range(65, 91)), b"0123456789", b"\n", b".,;:")
_LANES = []
for _i in range(0, len(_CLASSES), 3):
    _t = np.zeros(256, np.int64)
    for _k, _c in enumerate(_CLASSES[_i : _i + 3]):
        for _b in _c:
            _t[_b] = 1 << (21 * _k)
    _LANES.append(_t)


def class_counts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of each class by text: three classes share an integer, 21 bits each."""
    n = len(ends) - 1
    out = np.zeros((n, len(_CLASSES)), np.int64)
    if len(raw) >= 1 << 21:  # one long text: its lanes would overflow
        for k in range(n):
            c = np.bincount(raw[ends[k] : ends[k + 1]], minlength=256)
            out[k] = [c[list(x)].sum() for x in _CLASSES]
        return out
    full = np.diff(ends) > 0
    if not full.any():
        return out
    for lane, table in enumerate(_LANES):
        s = np.add.reduceat(table[raw], ends[:-1][full])
        for k in range(min(3, len(_CLASSES) - 3 * lane)):
            out[full, 3 * lane + k] = (s >> (21 * k)) & ((1 << 21) - 1)
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return s[first[1:]] - s[first[:-1]]


def _distinct(t: Tokens) -> np.ndarray:
    n = len(t.first) - 1
    if not len(t.hash):
        return np.zeros(n, np.int64)
    shift = np.uint64(max(1, int(n).bit_length()))
    keys = (t.hash >> shift) | (t.doc.astype(np.uint64) << (np.uint64(64) - shift))
    keys.sort()
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.bincount((keys[new] >> (np.uint64(64) - shift)).astype(np.int64), minlength=n)


def _listed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(h), bool)
    low = np.zeros(1 << 16, bool)
    low[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = low[(h & np.uint64(0xFFFF)).astype(np.int64)]
    (at,) = np.nonzero(out)
    out[at] = np.isin(h[at], words)
    return out


def features(texts: pa.Array, bad: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """One row a text, of the features ``NAMES``; a null or empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, j, raw, ends in groups(texts):
        t = Tokens(raw, ends)
        n = np.maximum(1, np.diff(ends))
        m = np.diff(t.first)
        some = np.maximum(1, m)
        size = t.end - t.start
        x = out[i:j]
        x[:, 0] = np.log1p(m)
        x[:, 1] = _sums(size, t.first) / some
        x[:, 2:9] = class_counts(raw, ends) / n[:, None]
        x[:, 9] = _sums(size <= 3, t.first) / some
        x[:, 10] = _distinct(t) / some
        hits = _sums(_listed(t.hash, toxic), t.first)
        x[:, 11] = _sums(_listed(t.hash, bad), t.first) / some
        x[:, 12] = hits / some
        x[:, 13] = hits
    return out


@dataclass
class Additive:
    """Cut points by feature, a table by feature, and tables of pairs over coarser cuts."""

    bias: float = 0.0
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            s += table[np.searchsorted(self.cuts[k], x[:, k], "right")]
        if self.pairs:
            c = [np.searchsorted(q, x[:, k], "right") for k, q in enumerate(self.coarse)]
            for a, b, table in self.pairs:
                s += table[c[a], c[b]]
        return s

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _quantile_cuts(v: np.ndarray, bins: int) -> np.ndarray:
    u = np.unique(v)
    if len(u) <= bins:
        return (u[1:] + u[:-1]) / 2
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """(gain, bins on the left) of the best split of a histogram."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + lam) + (g.sum() - a) ** 2 / (h.sum() - b + lam) - g.sum() ** 2 / (h.sum() + lam)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float, depth: int = 2) -> np.ndarray:
    """A shallow tree over bins as the value of each bin."""
    gain, k = _best_cut(g, h, lam) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + lam))
    return np.concatenate([_tree(g[:k], h[:k], lam, depth - 1), _tree(g[k:], h[k:], lam, depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    """A tree over two features: the better first cut, then a cut of the other feature on either side."""
    best = None
    for axis in (0, 1):
        gain, k = _best_cut(g.sum(1 - axis), h.sum(1 - axis), lam)
        if best is None or gain > best[0]:
            best = (gain, k, axis)
    _, k, axis = best
    out = np.zeros_like(g)
    for part in (slice(0, k), slice(k, None)):
        at = (part, slice(None)) if axis == 0 else (slice(None), part)
        values = _tree(g[at].sum(axis), h[at].sum(axis), lam, 1)
        out[at] = values[None, :] if axis == 0 else values[:, None]
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, lam: float = 2.0) -> Additive:
    """Cyclic boosting of log loss; with one class only, the constant of its share."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    m = Additive(bias=float(np.log(share / (1 - share))))
    if len(y) < 8 or y.min() == y.max():
        return m
    d = x.shape[1]
    m.cuts = [_quantile_cuts(x[:, k], BINS) for k in range(d)]
    m.coarse = [_quantile_cuts(x[:, k], PAIR_BINS) for k in range(d)]
    bins = [np.searchsorted(m.cuts[k], x[:, k], "right") for k in range(d)]
    m.tables = [np.zeros(len(m.cuts[k]) + 1) for k in range(d)]
    s = np.full(len(y), m.bias)
    for _ in range(rounds):
        for k in range(d):
            p = 1 / (1 + np.exp(-s))
            n = len(m.tables[k])
            step = rate * _tree(np.bincount(bins[k], y - p, n), np.bincount(bins[k], p * (1 - p), n), lam)
            m.tables[k] += step
            s += step[bins[k]]
    coarse = [np.searchsorted(m.coarse[k], x[:, k], "right") for k in range(d)]
    sizes = [len(c) + 1 for c in m.coarse]
    p = 1 / (1 + np.exp(-s))

    def two(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    gains = []
    for a in range(d):
        for b in range(a):
            g, h = two(a, b, y - p), two(a, b, p * (1 - p))
            gains.append((float((g * _tree2(g, h, lam)).sum()), a, b))
    m.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(pair_rounds):
        for a, b, table in m.pairs:
            p = 1 / (1 + np.exp(-s))
            step = rate * _tree2(two(a, b, y - p), two(a, b, p * (1 - p)), lam)
            table += step
            s += step[coarse[a], coarse[b]]
    return m


@dataclass
class Classifier:
    quality: Additive
    toxicity: Additive
    bad: np.ndarray
    toxic: np.ndarray


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad, toxic = batch.column("bad").to_numpy(), batch.column("toxic").to_numpy()
        for i, _, t in tokenised(batch.column("text")):
            pairs = np.unique(np.stack([t.hash, t.doc.astype(np.uint64)], 1), axis=0)
            doc = i + pairs[:, 1].astype(np.int64)
            h, at = np.unique(pairs[:, 0], return_inverse=True)
            cols = [np.bincount(at, w, len(h)).astype(np.int64) for w in (np.ones(len(at)), bad[doc], toxic[doc])]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, cols)], ["h", "n", "bad", "toxic"])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fits on at most ``max_rows`` labelled documents.

    Labels without an id or without a quality are left out, as are documents with a null or empty text; a null
    toxicity is 0. Of repeated labels the worst counts; of repeated documents the smallest text. Texts may be
    of any length; ids are whole numbers. Ties of the sample are decided by the id. Other columns are ignored,
    whatever their names. Without labelled documents quality is 1 and toxicity 0 for all.
    """
    ship(docs.sparkSession)
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    picked = picked.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__q"), F.max(F.coalesce("toxic", F.lit(0))).alias("__t"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)  # 24 bytes a row, so bounded
    rows = docs.select(named(id_col).cast("long").alias("__id"), named(text_col).alias("text")).where("text is not null and text <> ''")
    rows = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.min(F.struct("text", "__q", "__t")).alias("r"))
    half = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).cast("int")
    sample = written(rows.select("__id", half.alias("half"), "r.text", (F.col("r.__q") != 1).cast("int").alias("bad"), (F.col("r.__t") == 1).cast("int").alias("toxic")), "sample")
    n = sample.where("half = 0").agg(F.count(F.lit(1)), F.sum("bad"), F.sum("toxic")).first()
    lists = {}
    counts = sample.where("half = 0").select("text", "bad", "toxic").mapInArrow(_word_counts, "h long, n long, bad long, toxic long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "toxic")))
    counts = written(counts.where(f"n >= {LIST_DOCS}"), "words")
    for kind, of in (("bad", n[1] or 0), ("toxic", n[2] or 0)):
        rest = max(1, (n[0] or 0) - of)
        odds = F.log((F.col(kind) + 0.1) / (of + 1.0)) - F.log((F.col("n") - F.col(kind) + 0.1) / (rest + 1.0))
        top = counts.where(F.col(kind) >= LIST_DOCS).withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt(F.col(kind))), "h").limit(LIST_WORDS)
        lists[kind] = np.sort(np.array([r[0] for r in top.select("h").collect()], np.int64).view(np.uint64))
    bad, toxic = lists["bad"], lists["toxic"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"), bad, toxic)
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("bad"), b.column("toxic"), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "bad", "toxic", "x"])

    fitted = sample.where("half = 1").mapInArrow(rows_of, "id long, bad int, toxic int, x array<double>").toArrow().sort_by("id")
    for t in (sample, counts):
        removed(t)
    x = np.array(fitted["x"].to_pylist(), float).reshape(-1, len(NAMES))
    y = 1.0 - fitted["bad"].to_numpy()
    z = fitted["toxic"].to_numpy().astype(float)
    quality = fit(x, y) if len(y) else Additive(bias=10.0)
    return Classifier(quality, fit(x, z) if len(z) else Additive(bias=-10.0), bad, toxic)


def _scorer(docs: DataFrame, model: Classifier):
    """The model as a function of a text column."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables and word lists of fixed size: under 50 kB

    @F.arrow_udf("struct<q:double,t:double>")
    def scores(texts: pa.Array) -> pa.Array:
        m = shared.value
        x = features(texts, m.bad, m.toxic)
        some = x[:, 0] > 0
        cols = [np.where(some, np.round(f.probability(x), 9), 0.0) for f in (m.quality, m.toxicity)]
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["q", "t"])

    return scores


def score(docs: DataFrame, model: Classifier, *, text_col: str = "text", min_quality: float = 0.5, max_toxicity: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_score``, ``toxic_score`` and ``keep``; columns of these names are replaced.

    A null or empty text has quality 0 and toxicity 0, and isn't kept. Rows are judged one by one, so
    repeated rows get equal scores and a row's other columns, nulls among them, don't matter. Texts may be
    of any length; an empty table gives an empty result.
    """
    scores = _scorer(docs, model)
    kept = [c for c in docs.columns if c not in ("quality_score", "toxic_score", "keep")]
    own = fresh("scores", docs)
    out = docs.select(*(named(c) for c in kept), scores(F.coalesce(named(text_col), F.lit(""))).alias(own))
    q, t = F.col(own)["q"], F.col(own)["t"]
    return out.select(*(named(c) for c in kept), q.alias("quality_score"), t.alias("toxic_score"), ((q >= min_quality) & (t < max_toxicity)).alias("keep"))


def kept(docs: DataFrame, model: Classifier, *, text_col: str = "text", min_quality: float = 0.5, max_toxicity: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` would keep, with their own columns, whatever the names of these."""
    own = fresh("scores", docs)
    out = docs.withColumn(own, _scorer(docs, model)(F.coalesce(named(text_col), F.lit(""))))
    return out.where((F.col(own)["q"] >= min_quality) & (F.col(own)["t"] < max_toxicity)).drop(own)
