"""Deduplication, lookups with defaults, group counts and first-wins choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.session import written


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of smallest ``order`` for each key; null keys are one key. Rows equal in key and order: the smallest by their other columns.

    Every task passes on one row per key before the shuffle (a group limit below the window). All columns of ``df`` take part
    in the order, so select the ones that are needed first.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *rest))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def left_lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column, name: str, once: bool = False) -> DataFrame:
    """``df`` with the column ``name``: ``table``'s value for the key, else ``default``.

    Of several values of a key the smallest is taken, so no row of ``df`` doubles; ``once`` states that ``table`` has each key once and
    spares that. Null keys miss.
    """
    side = table.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    side = side if once else side.groupBy("_key").agg(F.min("_value").alias("_value"))
    return df.join(side, df[key] == side["_key"], "left").withColumn(name, F.coalesce(F.col("_value"), default)).drop("_key", "_value")


def flagged(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: whether ``members`` has the key; repeats there don't double rows, a null key is no member."""
    side = members.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    return df.join(side, df[key] == side["_key"], "left").withColumn(name, F.col("_key").isNotNull()).drop("_key")


def distribution(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, pct, first): counts and percentages by value, with the smallest ``order`` of each value to settle ties. No rows give none.

    The counts are written, so that ``df`` is evaluated once for them and their total.
    """
    counts = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("pct", F.col("n") / F.lit(float(max(total, 1))) * 100)


def exploded_counts(df: DataFrame, items: str, order: str) -> DataFrame:
    """(item, n, first): occurrences of array elements, with their first place (order, position); null and empty arrays add nothing."""
    e = df.select(F.col(order).alias("o"), F.posexplode(items).alias("pos", "item"))
    return e.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "pos")).alias("first"))


def counts_of_all(dimension: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``dimension`` with ``n``, the rows of ``df`` for each of its keys, 0 where there are none."""
    n = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return dimension.join(n, dimension[key] == n["_key"], "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_key", "_n")


def inverted_index(df: DataFrame, items: str, order: list[Column], payload: list[str]) -> DataFrame:
    """(item, postings, first): how often each array element occurs and the payload of its first occurrence in ``order``, then array position.

    Postings are counted, not gathered, so an item of very many rows costs one row per task.
    """
    e = df.select(F.struct(*order).alias("o"), *payload, F.posexplode(items).alias("pos", "item"))
    return e.groupBy("item").agg(F.count(F.lit(1)).alias("postings"), F.min(F.struct("o", "pos", *payload)).alias("f")).select("item", "postings", F.struct(*[F.col(f"f.{c}").alias(c) for c in payload]).alias("first"))
