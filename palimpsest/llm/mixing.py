"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its own weight (1, or a column) times a factor of its source, chosen so
that the source's share of the emitted characters is its target weight. Documents are put in a fixed
order, their expected copies summed from the start, and with one random offset a document is
emitted once for each integer boundary that its interval of the running sum crosses: between
``floor`` and ``ceil`` of what is expected, and a source's total is right to one copy.

All arithmetic after the factors is in integers (a copy is 2**32 units), so no result depends on the
order in which partitions were summed. A source may be most of the corpus, so its running sum isn't
one window: documents are ordered by (bucket, id) with ``bucket`` a hash of the id, the totals of the
buckets are summed first (a table of sources x buckets rows), and the windows run within buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.names import named

#: Units of one copy.
ONE = 1 << 32
#: Parts of a source whose running sums are independent. 30 billion documents, a third of them in
#: one source, are 2.5 million a bucket.
BUCKETS = 4096


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), named(source).cast("string")), F.lit("~"))


def _bucket(order: str, buckets: int) -> Column:
    """32 bits of the SHA-256 of the id as a string: any kind of id is spread evenly, and SQL can do the same."""
    h = F.conv(F.substring(F.sha2(named(order).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(h % F.lit(buckets), F.lit(0)).cast("int")


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    power: float = 0.5,
    rate: float = 1.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "n_chars",
    expect_col: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with ``copy`` from 1.

    weights: (source, weight), a weight of 0 or no row meaning that nothing is drawn. None: a source
    of C characters weighs C ** power. rate: characters to emit, as a share of those there are.

    expect_col: a number by which a document expects more or fewer copies than others of its source; null is
    1, below 0 is 0. The source's target holds all the same, if it has any document above 0.

    A null source is a source of its own. A document whose size is null or below 1 counts as 1; texts aren't
    read. A null id comes first in its source; ids may be of any kind that can be ordered. Repeated rows are
    documents like any other; ties of the id are ordered by a hash of the row. An empty table gives an empty
    result. A column of ``docs`` called ``copy`` is replaced; any other column is kept.
    """
    kept = [c for c in docs.columns if c != "copy"]
    size = F.greatest(F.coalesce(named(size_col).cast("bigint"), F.lit(1)), F.lit(1))
    own = F.lit(1.0) if expect_col is None else F.greatest(F.coalesce(named(expect_col).cast("double"), F.lit(1.0)), F.lit(0.0))
    own = F.floor(own * (1 << 20)).cast("bigint")  # so that sums don't depend on their order
    flat = [F.to_json(named(c)) if isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType)) else named(c) for c in kept]
    # a row is carried as one value, so no name of its columns can clash with those used here
    base = docs.select(F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(kept))).alias("__row"), named(id_col).alias("__id"), F.xxhash64(*flat).alias("__tie"), own.alias("__own"), _key(source_col).alias("__key"), _bucket(id_col, buckets).alias("__bucket"))
    thin = docs.select(_key(source_col).alias("__key"), _bucket(id_col, buckets).alias("__bucket"), size.alias("__size"), own.alias("__own"))

    sources = thin.groupBy("__key").agg(F.sum("__size").alias("__chars_s"), F.sum(F.col("__own").cast("decimal(20,0)") * F.col("__size")).cast("double").alias("__expected"))
    if weights is None:
        sources = sources.withColumn("__w", F.floor(F.pow(F.col("__chars_s").cast("double"), F.lit(float(power))) * 1024).cast("bigint"))
    else:
        given = weights.select(_key("source").alias("__key"), F.floor(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)) * (1 << 30)).cast("bigint").alias("__w"))
        given = given.groupBy("__key").agg(F.sum("__w").alias("__w"))
        sources = sources.join(given, "__key", "left").fillna(0, ["__w"])
    total = sources.agg(F.sum("__w").alias("__w_all"), F.sum("__chars_s").alias("__chars_all"))  # one row
    share = F.col("__w").cast("double") / F.nullif(F.col("__w_all"), F.lit(0)).cast("double")
    factor = F.col("__chars_all").cast("double") * F.lit(float(rate)) / F.nullif(F.col("__expected"), F.lit(0.0)) * share * float(ONE)
    sources = sources.crossJoin(F.broadcast(total)).select(
        "__key",
        F.coalesce(factor, F.lit(0.0)).alias("__f"),
        F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key")), 256), 1, 8), 16, 10).cast("bigint").alias("__u"),
    ).where("__f > 0")
    units = F.floor(F.col("__own").cast("double") * F.col("__f")).cast("decimal(20,0)")
    sums = thin.groupBy("__key", "__bucket", "__own").agg(F.count(F.lit(1)).alias("__n"))  # equal weights share one product
    sums = sums.join(sources, "__key").groupBy("__key", "__bucket", "__f", "__u").agg(F.sum(units * F.col("__n")).cast("decimal(30,0)").alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("decimal(30,0)")).select("__key", "__bucket", "__before", "__f", "__u")

    within = Window.partitionBy("__key", "__bucket").orderBy(F.col("__id").asc_nulls_first(), "__tie").rowsBetween(Window.unboundedPreceding, 0)
    # starts have (key, bucket) as their key too: the larger side is shuffled once, for the join and the window
    summed = base.join(starts, ["__key", "__bucket"]).withColumn("__units", units)
    summed = summed.withColumn("__upto", (F.col("__before") + F.sum("__units").over(within)).cast("decimal(30,0)"))
    drawn = summed.withColumn("__copies", F.expr(f"cast((__upto + __u) div {ONE} - (__upto - __units + __u) div {ONE} as int)")).where("__copies > 0")
    return drawn.select(*(F.col("__row")[f"c{k}"].alias(c) for k, c in enumerate(kept)), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))


#: DuckDB SQL of op5_systematic_mix.
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '~') AS key, greatest(coalesce(n_chars, 1), 1) AS size FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS chars, (sum(size) * 1048576)::DOUBLE AS expected, floor(sqrt(sum(size)::DOUBLE) * 1024)::BIGINT AS w FROM d GROUP BY key),
t AS (SELECT sum(w)::BIGINT AS w_all, sum(chars)::BIGINT AS chars_all FROM s),
e AS (SELECT key, floor(1048576::DOUBLE * (chars_all::DOUBLE * 1.0::DOUBLE / expected * (w::DOUBLE / w_all::DOUBLE) * {float(ONE)}::DOUBLE))::HUGEINT AS units,
  ('0x' || substr(sha256('mix-1:' || key), 1, 8))::BIGINT::HUGEINT AS u FROM s, t),
r AS (SELECT doc_id, source, units, u, sum(units) OVER (PARTITION BY key ORDER BY ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % {BUCKETS}, doc_id ROWS UNBOUNDED PRECEDING)::HUGEINT AS upto FROM d JOIN e USING (key)),
c AS (SELECT doc_id, source, ((upto + u) // {ONE} - (upto - units + u) // {ONE})::INT AS copies FROM r)
SELECT doc_id, source, unnest(range(1, copies + 1))::INT AS copy FROM c WHERE copies > 0
"""
