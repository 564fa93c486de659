"""Positions and running sums over any number of rows in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeward.sources.staging import cut


def running(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``rows`` with ``position`` from 1 and ``cumulative``, the sum of ``value`` up to each row, in the order of ``keys``.

    Two passes over a range partitioning: each range counts and sums for itself, and
    what lies before it, one number a range, is added. ``keys`` should tell all rows
    apart, so that ranges are even and the order is one.
    """
    sorted_ = rows.withColumn("_value", value).repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_ = cut(sorted_.withColumn("_part", F.spark_partition_id()))
    totals = sorted_.groupBy("_part").agg(F.count("*").alias("n"), F.coalesce(F.sum("_value"), F.lit(0)).cast("long").alias("s")).collect()
    n = s = 0
    before = []
    for r in sorted(totals, key=lambda r: r["_part"]):
        before.append((r["_part"], n, s))
        n, s = n + r["n"], s + r["s"]
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _n long, _s long")
    own = Window.partitionBy("_part").orderBy(*keys)
    out = sorted_.join(F.broadcast(offsets), "_part")
    here = F.sum(F.coalesce("_value", F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumns({"position": F.col("_n") + F.row_number().over(own), "cumulative": F.col("_s") + here})
    return out.drop("_part", "_value", "_n", "_s")
