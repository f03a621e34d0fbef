"""Places over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.plans.lineage import durable


def placed(rows: DataFrame, *order: Column | str, name: str = "place", total: Column | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in the given order, and with ``total`` the running sum of a whole number up to
    them as ``<name>_total``.

    Rows are dealt to ranges of the order and sorted there; what stands before a range is the sum over the ranges before
    it, one row each, and is sent to all tasks. The sorted rows are made durable, so that ranges stay what was counted.
    """
    n, s = f"__{name}_n", f"__{name}_s"
    valued = rows.withColumn(s, F.lit(0).cast("long") if total is None else total.cast("long"))
    ranged = valued.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("__part", F.spark_partition_id()).withColumn(n, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    if total is not None:
        within = Window.partitionBy("__part").orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
        numbered = durable(numbered).withColumn(f"{s}_upto", F.sum(s).over(within))
    made = durable(numbered)
    sizes = made.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), F.sum(s).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__rows", "__sum")])
    out = made.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__rows_before") + F.col(n) + 1).cast("int"))
    if total is not None:
        out = out.withColumn(f"{name}_total", F.col("__sum_before") + F.col(f"{s}_upto")).drop(f"{s}_upto")
    return out.drop("__part", n, s, "__rows_before", "__sum_before")
