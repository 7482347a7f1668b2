"""Records of a store as relations: manifests, references, names, packs, summaries, spans, ref logs, claims, approximate vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import digest
from palimpsest.operators.retrieval import chunks, ranked
from palimpsest.plans import merkle
from palimpsest.storage import ship


def manifests(docs: DataFrame, size: int = 2048, overlap: int = 256) -> DataFrame:
    """(doc_id, source, original, chunks, manifest): a manifest is the digest of its document's source, original and chunks in order."""
    parts = chunks(docs, size, overlap).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_hash"))), lambda c: c["chunk_hash"]).alias("chunks"))
    base = docs.where("text is not null").select("doc_id", "source", digest("blob", "text").alias("original"))
    out = base.join(parts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))
    return out.withColumn("manifest", digest("doc", F.concat_ws("\n", F.coalesce("source", F.lit("")), "original", F.array_join("chunks", ","))))


def reference_roots(rows: DataFrame, key: str, leaves: str) -> DataFrame:
    """(key, root, n): the sealed root over each row's list of hashes, in order."""
    ship(rows.sparkSession)

    @F.arrow_udf("string")
    def root(lists: pa.Array) -> pa.Array:
        return pa.array([merkle.sealed([merkle.leaf(h.encode()) for h in x or []]).hex() for x in lists.to_pylist()])

    return rows.select(key, root(leaves).alias("root"), F.size(leaves).alias("n"))


_REF = r"^[A-Za-z0-9_./-]+\z"


def ref_name_holds(name: Column) -> Column:
    """Whether a reference's name is allowed: the rules of ``engine.refs.valid_name`` as a column."""
    parts = F.split(name, "/")
    ok = F.rlike(name, F.lit(_REF)) & (F.size(parts) <= 5) & ~F.rlike(name, F.lit(r"(^|/)(\.|/|$)|\.\.|^-|\.$|\.lock$"))
    return F.coalesce(ok, F.lit(False))


def session_name_holds(name: Column) -> Column:
    return F.coalesce(F.rlike(name, F.lit(r"^[^/\x00-\x1f\x7f]+$")) & ~F.contains(name, F.lit("\n")), F.lit(False))


def not_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of blobs (hash, ...) that aren't stored yet, each once."""
    return new.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def united(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(hash, side): the union of two stores; ``both`` where they agree."""
    both = local.select("hash").distinct().withColumn("l", F.lit(True)).join(remote.select("hash").distinct().withColumn("r", F.lit(True)), "hash", "full_outer")
    return both.select("hash", F.when(F.col("r").isNull(), "local").when(F.col("l").isNull(), "remote").otherwise("both").alias("side"))


def latest_refs(log: DataFrame) -> DataFrame:
    """(name, value, changes) of a log (name, seq, value): the last of each name."""
    return log.groupBy("name").agg(F.max_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("changes"))


def ref_conflicts(log: DataFrame) -> DataFrame:
    """(name, seq) of entries (name, seq, expected, value) that expected another value than there was: a replay leaves them out.

    Entries count until one that doesn't fit; whether a later one fits is told by the last that did, so each name's log is
    folded in order. A log is one sequence by definition; names are spread over partitions.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now = None, None
        for b in batches:
            out = []
            for n, s, e, v in zip(*(b.column(c).to_pylist() for c in ("name", "seq", "expected", "value"))):
                if n != name:
                    name, now = n, None
                if e != now:
                    out.append((n, s))
                else:
                    now = v
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["name", "seq"])

    ordered = log.select(F.col("name").cast("string").alias("name"), F.col("seq").cast("long").alias("seq"), F.col("expected").cast("string").alias("expected"), F.col("value").cast("string").alias("value"))
    return ordered.repartition("name").sortWithinPartitions("name", "seq").mapInArrow(fold, "name string, seq long")


def introduced(refs: DataFrame, upto: int) -> DataFrame:
    """(target, manifest, generation): the newest manifest at or before a generation that refers to a chunk, of refs (target, manifest, generation)."""
    return refs.where(F.col("generation") <= upto).groupBy("target").agg(F.max_by("manifest", F.struct("generation", "manifest")).alias("manifest"), F.max("generation").alias("generation"))


def claim_faults(claims: DataFrame) -> DataFrame:
    """(claim_id, fault) of claims (claim_id, confidence, evidence) that may not be stored."""
    fault = F.when(F.coalesce(F.col("claim_id"), F.lit("")) == "", "no id").when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence").when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no evidence")
    return claims.select("claim_id", fault.alias("fault")).where("fault is not null")


def spans(runs: DataFrame) -> DataFrame:
    """``runs`` (run, parent) with the model of the run above, a self join."""
    above = runs.select(F.col("run").alias("parent"), F.col("role").alias("parent_role"))
    return runs.join(above, "parent", "left")


def two_stage(vectors: DataFrame, queries: dict[int, list[float]], k: int, widen: int = 4) -> DataFrame:
    """(query_id, doc_id, score, rank): candidates by signed-byte codes, ``widen`` times k of them, ranked again by the vectors.

    Both steps keep only the best of each partition before anything is shuffled; between them the candidates of
    all queries, k rows each, are joined back to their vectors.
    """
    ship(vectors.sparkSession)
    ids = np.array(sorted(queries), np.int64)
    dim = max((len(v) for v in queries.values()), default=0)
    q = np.array([queries[i] for i in ids.tolist()], np.float64).reshape(len(ids), dim)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = np.abs(x).max(axis=1, keepdims=True) / 127
        return np.sign(x) * np.floor(np.abs(x) / scale + 0.5), scale

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, s = codes(q)
        for b in batches:
            doc = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(doc), dim)
            norm = np.linalg.norm(x, axis=1)
            doc, x = doc[norm > 0], x[norm > 0] / norm[norm > 0, None]
            if not len(doc):
                continue
            d, t = codes(x)
            score = np.round((c @ d.T) * (s * t.T), 6)
            i, j = (z.ravel() for z in np.indices(score.shape))
            if len(doc) > widen * k:
                least = np.partition(score, len(doc) - widen * k, axis=1)[:, len(doc) - widen * k]
                i, j = np.nonzero(score >= least[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(doc[j]), pa.array(score[i, j])], ["query_id", "doc_id", "score"])

    v = vectors.select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("doc_id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    near = ranked(v.mapInArrow(coarse, "query_id long, doc_id long, score double"), widen * k).select("query_id", "doc_id")

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
            own = q[np.searchsorted(ids, b.column("query_id").to_numpy())]
            score = np.round((x * own).sum(1) / np.linalg.norm(x, axis=1), 6)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("doc_id"), pa.array(score)], ["query_id", "doc_id", "score"])

    return ranked(near.join(v, "doc_id").select("query_id", "doc_id", "v").mapInArrow(fine, "query_id long, doc_id long, score double"), k)


#: Vectors on which an approximate index's cells are fitted, whatever the number indexed.
SAMPLE = 20_000


class Cells:
    """An approximate index: vectors lie in the cell of the nearest of ``n`` centroids, and a query looks into the nearest cells.

    The centroids are fitted on at most ``SAMPLE`` vectors, those of the smallest hash of their id; every vector is
    indexed. A filter that leaves few vectors, or ``probes`` of all cells, makes the search exact.
    """

    def __init__(self, vectors: DataFrame, dim: int, n: int = 64, rounds: int = 12):
        ship(vectors.sparkSession)
        self.dim = dim
        fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull()))
        sample = fit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        x = sample["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = x[np.linalg.norm(x, axis=1) > 0]
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((1, dim))
        self.centroids = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
        for _ in range(rounds):
            at = np.argmax(x @ self.centroids.T, axis=1)
            for c in range(len(self.centroids)):
                if (at == c).any():
                    m = x[at == c].mean(0)
                    self.centroids[c] = m / max(np.linalg.norm(m), 1e-12)
        shared = vectors.sparkSession.sparkContext.broadcast(self.centroids)  # n times dim numbers

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
                ok = np.linalg.norm(v, axis=1) > 0
                cell = np.argmax(v @ shared.value.T, axis=1).astype(np.int32)
                keep = pa.array(np.nonzero(ok)[0])
                yield pa.RecordBatch.from_arrays([pa.array(cell[ok]), b.column(0).take(keep), b.column(1).take(keep)], ["cell", "vec_id", "embedding"])

        self.rows = fit.mapInArrow(place, "cell int, vec_id long, embedding array<double>")

    def search(self, queries: dict[int, list[float]], k: int, probes: int = 16) -> DataFrame:
        """(query_id, doc_id, score, rank) of the best in the ``probes`` cells nearest to each query."""
        ids = np.array(sorted(queries), np.int64)
        q = np.array([queries[i] for i in ids.tolist()], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        asks = np.zeros((len(self.centroids), len(ids)), bool)
        asks[near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])] = True
        dim = self.dim

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column(0).to_numpy()
                v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
                score = np.where(asks[cell], np.round((v @ q.T) / np.linalg.norm(v, axis=1)[:, None], 6), -np.inf)
                if len(b) > k:
                    score[score < np.partition(score, len(b) - k, axis=0)[len(b) - k]] = -np.inf
                i, j = np.nonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), b.column(1).take(pa.array(i)), pa.array(score[i, j])], ["query_id", "doc_id", "score"])

        return ranked(self.rows.mapInArrow(best, "query_id long, doc_id long, score double"), k)


def state_leaves(state: DataFrame) -> DataFrame:
    """(last_key, hash) of the leaves of the tree over (key, value), strings."""
    from palimpsest.plans.statetree import nodes_of

    rows = state.select(F.col("key").cast("binary").alias("key"), digest("blob", "value").alias("hash"))
    return nodes_of(rows, 0).select(F.col("key").cast("string").alias("last_key"), "hash")


def numbered_within(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
