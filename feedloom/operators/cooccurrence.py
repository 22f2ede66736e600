"""How often items occur together: large-basket blocking, pair counts and association scores.

Equal baskets are counted together first, so each set of items is looked at once. An ordinary basket gives its
pairs within its row. A huge one is split into chunks of items, and the chunk pairs, not the basket, are spread over the
tasks: each chunk is sent to the pairs it belongs to, so that no row holds more than two chunks, and a
task gives the product of the two. Counts are combined per task before the shuffle, so a frequent pair costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import written


def _pairs_within(items: Column) -> Column:
    rest = lambda i: F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
    return F.flatten(F.transform(items, lambda x, i: F.transform(rest(i), lambda y: F.struct(x.alias("item_a"), y.alias("item_b")))))


def _pairs_across(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias("item_a"), y.alias("item_b")))))


def item_sets(baskets: DataFrame, items: str) -> DataFrame:
    """(items, copies): every set of items, sorted, with the number of rows that hold just these; null elements don't count, a null array is empty."""
    clean = F.array_sort(F.array_distinct(F.array_compact(F.col(items))))
    return baskets.select(F.coalesce(clean, F.slice(clean, 1, 0), F.array().cast(baskets.schema[items].dataType)).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("copies"))


def _identified(sets: DataFrame) -> DataFrame:
    """``sets`` with an ``id`` each, written, so that the ids stay what they are."""
    return written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")


def chunk_sides(huge: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(lefts, rights) of the chunk pairs i <= j of (id, items, copies) rows: each chunk once per pair it is in.

    Chunks are spread before they are repeated, since a basket of m chunks gives m (m + 1) of them.
    """
    last = F.floor((F.size("items") - 1) / chunk).cast("int")
    slices = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("items", k * chunk + 1, chunk))
    spread = int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = huge.select("id", "copies", last.alias("last"), F.posexplode(slices).alias("c", "part")).repartition(spread, "id", "c")
    lefts = chunks.select("id", "copies", F.col("c").alias("i"), F.explode(F.sequence("c", "last")).alias("j"), F.col("part").alias("left"))
    rights = chunks.select("id", F.explode(F.sequence(F.lit(0), "c")).alias("i"), F.col("c").alias("j"), F.col("part").alias("right"))
    return lefts, rights


def _pairs_of(sets: DataFrame, chunk: int) -> DataFrame:
    """(item_a, item_b, together) of (id, items, copies) rows."""
    ordinary = sets.where((F.size("items") > 1) & (F.size("items") <= chunk)).select("copies", F.explode(_pairs_within(F.col("items"))).alias("p"))
    lefts, rights = chunk_sides(sets.where(F.size("items") > chunk), chunk)
    products = F.when(F.col("i") == F.col("j"), _pairs_within(F.col("left"))).otherwise(_pairs_across(F.col("left"), F.col("right")))
    blocked = lefts.join(rights, ["id", "i", "j"]).select("copies", F.explode(products).alias("p"))
    return ordinary.unionByName(blocked).groupBy("p.item_a", "p.item_b").agg(F.sum("copies").alias("together"))


def pair_counts(baskets: DataFrame, items: str, chunk: int = 64) -> DataFrame:
    """(item_a, item_b, together) with item_a < item_b: the number of rows that hold both items.

    ``items`` is an array column; an item counts once per row, nulls never, and null or one-item arrays give
    no pairs. Every row is a basket of its own, so repeated rows count again.
    """
    if chunk < 2:
        raise ValueError("chunk must be 2 at least")
    return _pairs_of(_identified(item_sets(baskets, items)), chunk)


def _counts_of(sets: DataFrame) -> DataFrame:
    return sets.select("copies", F.explode("items").alias("item")).groupBy("item").agg(F.sum("copies").alias("n"))


def item_counts(baskets: DataFrame, items: str) -> DataFrame:
    """(item, n): the number of rows that hold each item."""
    return _counts_of(item_sets(baskets, items))


def associations(baskets: DataFrame, items: str, min_records: int = 1, chunk: int = 64, min_share: tuple[int, int] = (0, 1)) -> DataFrame:
    """Pairs held together by ``min_records`` rows and the share ``min_share`` of all rows or more, with their association scores.

    Columns: item_a, item_b, together, n_a, n_b, total, lift (together against the number chance would
    give), pmi (its natural logarithm) and excess (together minus that number). ``total`` is the number of all rows,
    those without items too. No item is in such a pair unless it is itself in as many rows, so rarer
    items are left out before pairs are made; that changes no result. Ties, repeated rows and empty tables
    need no rule: every pair has one row, and no rows give none.

    The sets are written once, so ``baskets`` is read once. Rarer items leave by a semi-join, which Spark broadcasts if it is small.
    """
    if chunk < 2:
        raise ValueError("chunk must be 2 at least")
    sets = _identified(item_sets(baskets, items))
    total = sets.agg(F.sum("copies")).first()[0] or 0
    least = max(min_records, -(-total * min_share[0] // min_share[1]))
    counts = _counts_of(sets).where(F.col("n") >= least)
    kept = sets.where(F.size("items") > 1)
    if least > 1:
        frequent = kept.select("id", "copies", F.explode("items").alias("item")).join(counts.select("item"), "item", "left_semi")
        kept = frequent.groupBy("id", "copies").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = _pairs_of(kept, chunk).where(F.col("together") >= least)
    n = lambda side: counts.select(F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"))
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.lit(float(max(total, 1)))
    return (
        pairs.join(n("a"), "item_a")
        .join(n("b"), "item_b")
        .select("item_a", "item_b", "together", "n_a", "n_b", F.lit(total).cast("bigint").alias("total"))
        .withColumns({"lift": F.col("together") / expected, "pmi": F.log(F.col("together") / expected), "excess": F.col("together") - expected})
    )
