"""Steps whose size must not follow that of a whole table: small tables, cut as large ones are."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import memory as M
from palimpsest.operators import retrieval as R
from palimpsest.plans import merkle
from palimpsest.plans.sequences import numbered
from palimpsest.queries.retrieval import judged


@pytest.fixture()
def cut(spark):
    """Ranges stay apart however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_go_on_from_range_to_range(spark, cut):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), f"v{k}" if k % 3 else None) for k in range(400)] + [(None, "a", "first"), (5000, "c", "alone")]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "id long, head string, v string")
    want, last = {}, {}
    for k, head, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        n, was = last.get(head, (-1, (None, None)))
        want[k, head] = (n + 1, *was)
        last[head] = (n + 1, (k, v))
    got = numbered(df, "head", ["id"], "n", {"was": "id", "last": "v"})
    assert {(r.id, r.head): (r.n, r.was, r.last) for r in got.collect()} == want
    assert numbered(df.limit(0), "head", ["id"], "n").collect() == []


def test_no_task_has_a_whole_log(spark, cut):
    df = spark.range(0, 7000, 1, 4).select(F.lit("x").alias("head"), (F.col("id") * 2).alias("seq"))
    found = M.gaps(df.where("seq <> 600"), "head", "seq")
    assert sorted((r.seq, r.missing) for r in found.collect() if r.missing != 1) == [(602, 3)] and found.count() == 6998
    sizes = numbered(df, "head", ["seq"], "n").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 7000 * 0.7


def test_workers_get_short_runs_of_hashes(spark, monkeypatch):
    rows = spark.range(0, 9000, 1, 3).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("data"))
    sizes, made = [], merkle.written
    monkeypatch.setattr(merkle, "written", lambda df, name: sizes.append((name, (w := made(df, name)).agg(F.max(F.length("hashes"))).first()[0])) or w)
    got = merkle.root(rows, "data", "data", block_bits=5).first()
    assert (got.root, got.n) == (merkle.sealed([merkle.leaf(f"{k:05}".encode()) for k in range(9000)]).hex(), 9000)
    assert sizes[0][0] == "leaves" and max(n for _, n in sizes) <= 32 * merkle.ROW


def test_runs_are_put_together_to_blocks():
    import pyarrow as pa

    h = [merkle.leaf(str(k).encode()) for k in range(100)]
    runs = [(at, b"".join(h[at : at + n])) for at, n in ((3, 3), (6, 7), (13, 20), (40, 1), (41, 7), (60, 4), (64, 16))]
    batches = [pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x], pa.binary())], ["at", "hashes"]) for at, x in runs]
    got = [r for b in merkle._blocks(iter(batches), 8) for r in b.to_pylist()]
    assert [(r["at"], r["whole"]) for r in got] == [(3, False), (8, True), (16, True), (24, True), (32, False), (40, True), (60, False), (64, True), (72, True)]
    assert all(r["hashes"] == (merkle.fold(h[r["at"] : r["at"] + 8]) if r["whole"] else h[r["at"]] if r["at"] == 32 else b"".join(h[r["at"] : (r["at"] // 8 + 1) * 8])) and r["block"] == r["at"] // 8 for r in got)


def test_postings_of_unique_ids_are_not_shuffled(spark):
    rows = [(1, "a b A"), (2, "c " * 9), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = R.postings(df)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2), (1, "b", 1), (2, "c", 9)]
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [10_000, 1])
def test_ids_of_several_rows_are_added_up(spark, monkeypatch, most):
    monkeypatch.setattr(R, "REPEATED", most)
    rows = [(1, "a b"), (1, "a c"), (2, "a"), (None, "x"), (None, "x y"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, R.postings(df).collect()), key=str) == sorted([(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "a", 1), (None, "x", 2), (None, "y", 1), (3, "a", 1), (3, "b", 1)], key=str)
    q = spark.createDataFrame([(0, "a b c"), (1, "a a b"), (2, "zz")], "query_id long, text string")
    own = df.where("doc_id is not null")
    of = R.counted(own, R.query_terms(q))
    got = sorted(map(tuple, R.having(own, of, 9).collect()))
    assert got == sorted(tuple(r)[:2] for r in judged(own, q).collect()) == [(0, 1), (1, 1), (1, 3)]


def test_no_query_s_relevant_documents_are_all_sorted(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 5000, 2)], "query_id long, doc_id long, rank int")
    rel = spark.range(0, 3000).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("doc_id"), F.lit(1).alias("rel"))
    got = R.rank_quality(hits, rel, 2)
    assert sorted(map(tuple, got.collect())) == [(0, 0.0, 0.0), (1, 0.613147, 0.000667)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
