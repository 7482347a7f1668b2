"""Structured Streaming: the event feed, windowed counts and the micro-batch state writer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.engine.fs import Folder
from palimpsest.operators.memory import write_many


def events(spark: SparkSession, path: str, schema, since: int | None = None, kind: str | None = None) -> DataFrame:
    """The feed of a folder of Parquet files, after a cursor and of one kind, if given."""
    feed = spark.readStream.schema(schema).parquet(path)
    if since is not None:
        feed = feed.where(F.col("event_id") > since)
    return feed if kind is None else feed.where(F.col("event_type") == kind)


def windowed_counts(feed: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) by tumbling window; events later than the watermark are dropped."""
    counts = feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


#: Parts of a state by the hash of its keys: a batch writes those that it touches.
PARTS = 64


def write_state(ops: DataFrame, path: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Applies (key, value, ordinal) in micro-batches: batch b makes version b + 1 of version b, so a batch that is run again writes the same.

    A version is a list of the files of each part; a batch writes the parts in which it has keys, and then the list.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = Folder(spark, path)
        known = folder.json(f"versions/{number:012}.json", {}) if number else {}
        own = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
        touched = sorted(r.part for r in batch.select(own.alias("part")).distinct().collect())  # as many as there are parts at most
        base = _parts(spark, path, {k: v for k, v in known.items() if int(k) in touched})
        new = write_many(base.select("key", "value"), batch).withColumn("part", own)
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/{number + 1:012}")
        folder.write(f"versions/{number + 1:012}.json", json.dumps(known | {str(p): number + 1 for p in touched}).encode())

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str, known: dict[str, int]) -> DataFrame:
    folder = Folder(spark, path)
    found = [f"{path}/data/{v:012}/part={p}" for p, v in known.items() if folder.exists(f"data/{v:012}/part={p}")]  # a part may be empty
    if not found:
        return spark.createDataFrame([], "key string, value string")
    return spark.read.schema("key string, value string").parquet(*found)


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(key, value) at a version, or the last."""
    folder = Folder(spark, path)
    names = folder.list("versions")
    if not names and version in (None, 0):
        return _parts(spark, path, {})
    known = folder.json(f"versions/{names[-1]}" if version is None else f"versions/{version:012}.json")
    if known is None:
        raise KeyError(f"no version {version}")
    return _parts(spark, path, known)
