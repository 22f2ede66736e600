"""Positions, running totals and percentiles over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.session import written


def _ranged(df: DataFrame, order: list[Column], amount: Column) -> DataFrame:
    """``df`` with ``_amount``, range-partitioned by ``order`` and written with the partition, ``_part``."""
    return written(df.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def _summed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``_ranged`` rows with the running total ``name``: a window within each partition, and offsets from the partitions' sums."""
    sums = rows.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "_part").withColumn(name, (F.col("_before") + F.sum("_amount").over(within)).cast("bigint")).drop("_part", "_amount", "_before")


def running_total(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over all rows up to and with this one in ``order``, which must leave no ties.

    Rows are range-partitioned by the whole order and written with their partition; the partitions' sums, one row each, give the
    offsets, and a window runs within each partition only.
    """
    return _summed(_ranged(df, order, amount), order, name)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name`` counting from 1 in ``order``."""
    return running_total(df, order, F.lit(1), name)


def percentile_score(df: DataFrame, value: Column, name: str, scale: float = 10.0) -> DataFrame:
    """``df`` with ``name``: the share of rows of strictly smaller value times ``scale``, rounded half to even to one place.

    Equal values are counted together first, so the running total goes over distinct values, which also give the number of rows. Null
    counts below every value. ``df`` is evaluated for its values and once more for the result: pass a written table where that is dear.
    """
    rows = df.withColumn("_value", value)
    order = [F.col("_value").asc_nulls_first()]
    counts = _ranged(rows.groupBy("_value").agg(F.count(F.lit(1)).alias("_n")), order, F.col("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    ranked = _summed(counts, order, "_upto").withColumn("_below", F.col("_upto") - F.col("_n"))
    score = F.bround(F.col("_below") / F.lit(float(max(total, 1))) * scale, 1)
    side = ranked.select(F.col("_value").alias("_v"), score.alias(name))
    return rows.join(side, F.col("_value").eqNullSafe(F.col("_v"))).drop("_value", "_v")
