"""Snapshots: tables written to a folder with a digest of each, and read back only if it still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGESTS = "digests"


def digest_of(df: DataFrame) -> tuple[int, str]:
    """(rows, digest), whatever the rows' order: the sum of a hash of each row as JSON, exact in decimals."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    n, *sums = df.agg(F.count(F.lit(1)), *parts).first()
    return n, ":".join(str(s or 0) for s in sums)


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each table as zstd Parquet, then the digests, so a snapshot without digests was cut short."""
    found = []
    for name, df in sorted(tables.items()):
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        spark = df.sparkSession
        found.append((name, *digest_of(spark.read.parquet(f"{path}/{name}"))))
    spark.createDataFrame(found, "name string, n long, digest string").coalesce(1).write.parquet(f"{path}/{DIGESTS}")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; ValueError names those that changed."""
    known = spark.read.parquet(f"{path}/{DIGESTS}").collect()  # a row a table
    tables = {r.name: spark.read.parquet(f"{path}/{r.name}") for r in known}
    bad = [r.name for r in known if digest_of(tables[r.name]) != (r.n, r.digest)]
    if bad:
        raise ValueError(f"changed since the snapshot: {', '.join(bad)}")
    return tables
