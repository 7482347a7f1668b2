"""Numbers and predecessors within sequences of any length: no task sorts a whole one.

Rows are cut to ranges of the order, which are numbered each for itself. Only the first sequence of a range may go
on from the range before, so a row a range at most is joined back: how many rows came before, and the last of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import written


def numbered(rows: DataFrame, by: str, order: list[str], number: str, before: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with their number in the order within ``by``, from 0, and of ``before`` {new column: column} the values of the row before, null for the first.

    The ranges are written to the shared folder, since they wouldn't be cut twice in the same places.
    """
    before = before or {}
    table = written(rows.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    w, v = Window.partitionBy("__part", by).orderBy(*order), Window.partitionBy(by).orderBy("__part")
    here = table.withColumns({"__n": (F.row_number().over(w) - 1).cast("long")} | {f"__before_{k}": F.lag(c).over(w) for k, c in before.items()})
    last = F.max_by(F.struct(F.lit(True).alias("__is"), *(F.col(c).alias(k) for k, c in before.items())), F.struct(*order))
    ends = table.groupBy("__part", by).agg(F.count(F.lit(1)).alias("__size"), last.alias("__tail"))
    starts = ends.select(F.col("__part").alias("__p"), F.col(by).alias("__by"), F.sum("__size").over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("__start"), F.lag("__tail").over(v).alias("__tail"))
    out = here.join(F.broadcast(starts.where("__start > 0")), (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    carried = [F.when(F.col("__n") == 0, F.col("__tail")[k]).otherwise(F.col(f"__before_{k}")).alias(k) for k in before]
    return out.select(*rows.columns, (F.col("__n") + F.coalesce("__start", F.lit(0))).alias(number), *carried)
