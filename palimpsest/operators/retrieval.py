"""Retrieval: visibility, chunks, postings, BM25, exact vector search, rank fusion, ranking quality.

Every search takes many queries at once, (query_id, text) or (query_id, embedding), so a scan of the corpus
is shared by all of them. Rank ties are broken by id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import digest, splitter, tokens
from palimpsest.storage import ship, spread, written

K1, B, RRF = 1.5, 0.75, 60


def visible(
    docs: DataFrame,
    *,
    tenant: str | None = None,
    doc_type: str | None = None,
    language: str | None = None,
    tags: tuple[str, ...] = (),
    at: int | None = None,
    generation: int | None = None,
) -> DataFrame:
    """The rows that a caller may see. Access tags always count; validity only if ``at`` is given.

    An attribute that is asked for and null doesn't match. Equality predicates reach the scan.
    """
    acl = F.coalesce(F.col("acl"), F.array().cast("array<string>"))  # no list is as an empty one: public
    ok: Column = F.size(acl) == 0
    if tags:
        ok |= F.coalesce(F.arrays_overlap(acl, F.array(*map(F.lit, tags))), F.lit(False))
    for name, value in (("tenant", tenant), ("doc_type", doc_type), ("language", language)):
        if value is not None:
            ok &= F.col(name) == value
    if at is not None:
        ok &= F.col("valid_from").isNull() | (F.col("valid_from") <= at)
        for end in ("valid_to", "expires_at"):
            ok &= F.col(end).isNull() | (F.col(end) > at)
    if generation is not None:
        ok &= F.col("generation") <= generation
    return docs.where(ok)


def chunks(docs: DataFrame, size: int = 2048, overlap: int = 256) -> DataFrame:
    """(doc_id, ordinal, start, end, chunk_hash) of byte chunks; the first that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    raw = spread(docs.select("doc_id", "text")).select("doc_id", F.encode("text", "UTF-8").alias("raw")).where("raw is not null and length(raw) > 0").withColumn("n", F.length("raw"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    out = raw.select("doc_id", "raw", "n", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    start, end = F.col("ordinal") * step, F.least(F.col("ordinal") * step + size, F.col("n"))
    return out.select("doc_id", "ordinal", start.alias("start"), end.alias("end"), digest("blob", F.expr(f"substring(raw, ordinal * {step} + 1, {size})")).alias("chunk_hash"))


def terms_of(docs: DataFrame, *keep: str) -> DataFrame:
    """A row a token. An outer explode, since a plain one makes the optimizer split each text once more to see that it has tokens."""
    return spread(docs.select(*keep, "text")).select(*keep, F.explode_outer(tokens("text")).alias("term")).where("term is not null")


#: Ids of several rows that are gathered on the driver, and terms of a batch of postings.
REPEATED, BATCH = 10_000, 65_536


def merged(docs: DataFrame, found: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found``, of rows of single documents, with ``merge`` over those whose id several rows of ``docs`` have; nothing is shuffled where ids are unique."""
    ids = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    rows = ids.limit(REPEATED + 1).collect()
    if not rows:
        return found
    if len(rows) > REPEATED:
        return merge(found)
    several = F.broadcast(docs.sparkSession.createDataFrame(rows, ids.schema))
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    return found.join(several, same, "left_anti").unionByName(merge(found.join(several, same, "left_semi")))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf). Terms are counted text by text, so no table of many documents' terms is kept; only ids of several rows are added up."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for b in batches:
            row, term, tf = [], [], []
            texts = b.column(1)
            for i in range(len(b) + 1):
                if row and (i == len(b) or len(row) >= BATCH):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(term, pa.string()), pa.array(tf, pa.int64())], ["doc_id", "term", "tf"])
                    row, term, tf = [], [], []
                if i < len(b) and (text := texts[i].as_py()):
                    seen = Counter(split(text))
                    row += [i] * len(seen)
                    term += seen
                    tf += seen.values()

    rows = docs.select("doc_id", "text")
    found = spread(rows).mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, term string, tf long")
    return merged(docs, found, lambda f: f.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokens("text")).alias("dl"))


#: Terms of all queries together that are gathered on the driver.
ASKED = 200_000
#: Entries of the table of query terms by queries that is sent to every worker (8 bytes each).
WEIGHTS = 8_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    return terms_of(queries, "query_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def occurrences(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, dl, term, tf): a row a document, with the numbers of the terms that it has and how often; every text is split once."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, split = shared.value, splitter()
        for b in batches:
            sizes, ends, which, times = [], [0], [], []
            for text in b.column(1).to_pylist():
                found = split(text) if text else []
                seen = Counter(found)
                hits = [(number[t], n) for t, n in seen.items() if t in number] if len(seen) < len(number) else [(k, seen[t]) for t, k in number.items() if t in seen]
                which += [k for k, _ in hits]
                times += [n for _, n in hits]
                ends.append(len(which))
                sizes.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (which, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), *lists], ["doc_id", "dl", "term", "tf"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(count, "doc_id long, dl int, term array<int>, tf array<int>")


class Counted(NamedTuple):
    """Terms asked for, and how often each document has them, written (doc_id, dl, term, tf)."""

    found: DataFrame
    rows: list  # (query_id, term, qtf)
    terms: list[str]
    ids: np.ndarray


def counted(docs: DataFrame, asked: DataFrame) -> Counted | None:
    """The terms of ``asked`` (query_id, term, qtf) in documents, or None where they are too many for tables on every worker."""
    rows = asked.limit(ASKED + 1).collect()
    terms, ids = sorted({r.term for r in rows}), np.array(sorted({r.query_id for r in rows}), np.int64)
    if len(rows) > ASKED or len(terms) * len(ids) > WEIGHTS:
        return None
    return Counted(written(occurrences(docs, terms), "occurrences"), rows, terms, ids)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that has a term of the query; with ``k``, of the k best of each partition at least.

    Statistics are those of ``docs``, so what a filter hides has no influence on a score. Terms of a
    query count once in the document frequency and as often as they occur in the sum.

    Where the weights of all query terms fit a table of ``WEIGHTS`` entries, texts are split once, the terms
    asked for are counted by document and written, and documents are scored where they are, a batch at a
    time as a matrix product; with ``k`` only the best of each partition are shuffled. Beyond, the terms
    are joined by a shuffle, to the same scores.
    """
    asked = query_terms(queries)
    of = counted(docs, asked)
    return joined_bm25(docs, asked) if of is None else scored(of, k)


def scored(of: Counted, k: int | None = None) -> DataFrame:
    """The scores of ``bm25`` by matrices."""
    found, rows, terms, ids = of
    df, n, total = np.zeros(len(terms)), 0, 0
    for r in found.mapInArrow(_counted, "term int, n long, dl long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).collect():  # a row a query term, and one
        if r.term < 0:
            n, total = r.n, r.dl
        else:
            df[r.term] = r.n
    avgdl = max(1.0, total / n) if n else 1.0
    weights = np.zeros((len(terms), len(ids)))
    number, at = {t: i for i, t in enumerate(terms)}, {int(q): i for i, q in enumerate(ids)}
    for r in rows:
        d = df[number[r.term]]
        if d:
            weights[number[r.term], at[r.query_id]] = r.qtf * math.log((n - d + 0.5) / (d + 0.5) + 1)
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, kept = shared.value, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                doc, dl, t = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
                row = np.repeat(np.arange(len(part)), pc.list_value_length(t).to_numpy())
                tf = part.column(3).flatten().to_numpy().astype(float)
                there, col = np.unique(t.flatten().to_numpy(), return_inverse=True)
                a = np.zeros((len(part), len(there)))
                a[row, col] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
                own = w[there]
                s = np.round(a @ own, 6)
                has = (a > 0).astype(np.float32) @ (own != 0).astype(np.float32) > 0
                i, q = np.nonzero(has)
                got = (q, doc[i], s[i, q])
                if k is None:
                    yield _scores(ids, got)
                else:
                    kept = best_of(k, *(np.concatenate(x) for x in zip(kept, got)))
        if k is not None:
            yield _scores(ids, kept)

    return found.mapInArrow(score, "query_id long, doc_id long, score double")


def having(docs: DataFrame, of: Counted, tenths: int) -> DataFrame:
    """(query_id, doc_id) of documents that have so many tenths of a query's different terms: counted where they are, as a matrix product."""
    number, at = {t: i for i, t in enumerate(of.terms)}, {int(q): i for i, q in enumerate(of.ids)}
    asks = np.zeros((len(of.terms), len(of.ids)), np.float32)
    for r in of.rows:
        asks[number[r.term], at[r.query_id]] = 1
    shared, ids, need = docs.sparkSession.sparkContext.broadcast(asks), of.ids, asks.sum(0) * tenths

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                t = part.column("term")
                row = np.repeat(np.arange(len(part)), pc.list_value_length(t).to_numpy())
                there, col = np.unique(t.flatten().to_numpy(), return_inverse=True)
                a = np.zeros((len(part), len(there)), np.float32)
                a[row, col] = 1
                m = a @ shared.value[there]
                i, q = np.nonzero((m > 0) & (m * 10 >= need))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), part.column("doc_id").take(pa.array(i))], ["query_id", "doc_id"])

    rows = merged(docs, of.found.select("doc_id", "term"), lambda f: f.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("term"))).alias("term")))
    return rows.mapInArrow(enough, "query_id long, doc_id long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each term, and as term -1 the documents and their length."""
    for b in batches:
        t, c = np.unique(b.column("term").flatten().to_numpy(), return_counts=True)
        dl = int(b.column("dl").to_numpy().sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1).astype(np.int32)), pa.array(np.append(c, len(b)).astype(np.int64)), pa.array(np.append(np.zeros(len(t)), dl).astype(np.int64))], ["term", "n", "dl"])


def _scores(ids: np.ndarray, got: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[got[0]]), pa.array(got[1]), pa.array(got[2])], ["query_id", "doc_id", "score"])


def best_of(k: int, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, equal scores in order of the document."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], doc[keep], score[keep]


def joined_bm25(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The scores of ``bm25`` by joins, for any number of query terms (query_id, term, qtf)."""
    sized = docs.select("doc_id", tokens("text").alias("ts")).withColumn("dl", F.size("ts"))
    corpus = sized.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))  # one row
    found = sized.select("doc_id", "dl", F.explode_outer("ts").alias("term")).where("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
    found = found.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = asked.join(df, "term").crossJoin(F.broadcast(corpus)).select("query_id", "term", "avgdl", (F.col("qtf") * idf).alias("w"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(weights.hint("shuffle_hash"), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """``scores`` with ``rank`` from 1 to k; ranking by query is cut within partitions before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, queries: dict[int, list[float]], k: int) -> DataFrame:
    """(query_id, doc_id, score): cosine similarity, the k best of each partition at least.

    Batches are multiplied as matrices; each partition keeps its best k a query, so k rows a query and
    partition are all that is shuffled. Vectors of another length or of norm 0 are left out.
    """
    ship(vectors.sparkSession)
    ids = np.array(sorted(queries), np.int64)
    dim = max((len(v) for v in queries.values()), default=0)
    q = np.array([queries[i] for i in ids.tolist()], np.float64).reshape(len(ids), dim)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for b in batches:
            doc = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(doc), dim)
            norm = np.linalg.norm(x, axis=1)
            doc, x = doc[norm > 0], x[norm > 0] / norm[norm > 0, None]
            if not len(doc):
                continue
            s = np.round(q @ x.T, 6)
            if len(doc) > k:  # those at least as good as the k-th
                least = np.partition(s, len(doc) - k, axis=1)[:, len(doc) - k]
                i, j = np.nonzero(s >= least[:, None])
            else:
                i, j = (z.ravel() for z in np.indices(s.shape))
            kept = best_of(k, *(np.concatenate(z) for z in zip(kept, (i, doc[j], s[i, j]))))
        yield _scores(ids, kept)

    fit = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull()))
    return fit.mapInArrow(best, "query_id long, doc_id long, score double")


def vector_topk(vectors: DataFrame, queries: dict[int, list[float]], k: int) -> DataFrame:
    return ranked(vector_scores(vectors, queries, k), k)


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (60 + rank)."""
    if not lists:
        raise ValueError("a hybrid search needs a text or a vector")
    every = lists[0].select("query_id", "doc_id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "doc_id", "rank"))
    return ranked(every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 9).alias("score")), k)


def hybrid(docs: DataFrame, vectors: DataFrame, texts: DataFrame, embeddings: dict[int, list[float]], k: int = 10) -> DataFrame:
    """Both modalities fetch 4k, of documents in ``docs`` only."""
    allowed = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return fused([ranked(bm25(docs, texts, 4 * k), 4 * k), vector_topk(allowed, embeddings, 4 * k)], k)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the largest ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, scale, codes): signed bytes of each vector, by its largest magnitude."""
    v = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.withColumn("scale", F.array_max(F.transform("v", F.abs)) / 127).where("scale > 0")
    return v.select("vec_id", "scale", F.transform("v", lambda x: F.round(x / F.col("scale")).cast("int")).alias("codes"))


def rank_quality(hits: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg, recall) at k; relevance is (query_id, doc_id, rel), of which a query may have none."""
    good, w = relevance.where("rel > 0"), Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    gain = lambda rel, rank: F.col(rel) / F.log2(F.col(rank) + 1)
    best = good.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain("rel", "r")).alias("best"))  # cut within partitions
    ideal = best.join(good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id")
    got = hits.where(F.col("rank") <= k).join(relevance.where("rel > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain("rel", "rank")).alias("dcg"), F.count(F.lit(1)).alias("m"))
    both = ideal.join(got, "query_id", "left").fillna(0, ["dcg", "m"])
    return both.select("query_id", F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg"), F.round(F.col("m") / F.col("n"), 6).alias("recall"))
