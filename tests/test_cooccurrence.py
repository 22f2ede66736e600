import random
from collections import Counter
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from feedloom.operators.cooccurrence import _identified, associations, chunk_sides, item_sets, pair_counts

SCHEMA = "id int, items array<string>, together string"


def brute(rows):
    return Counter(p for _, items, _ in rows for p in combinations(sorted({x for x in items or [] if x is not None}), 2))


def found(df, chunk):
    return {(r.item_a, r.item_b): r.together for r in pair_counts(df, "items", chunk).collect()}


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_against_brute_force(spark, chunk):
    rnd = random.Random(1)
    rows = [(i, [f"t{rnd.randint(0, 20)}" for _ in range(rnd.randint(0, 12))], None) for i in range(200)]
    rows += [(200, None, None), (201, [], None), (202, ["a", None, "a"], None), (203, [None], None), (204, ["b", "a"], None), (204, ["b", "a"], None)]
    assert found(spark.createDataFrame(rows, SCHEMA), chunk) == brute(rows)


def test_huge_basket(spark):
    rows = [(0, [f"i{k}" for k in range(300)], None), (1, ["i1", "i2"], None)]
    got = found(spark.createDataFrame(rows, SCHEMA), 16)
    assert len(got) == 300 * 299 // 2
    assert got["i1", "i2"] == 2 and sum(got.values()) == 300 * 299 // 2 + 1


def test_a_huge_basket_is_sent_chunk_by_chunk(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("string")).alias("items"))
    sides = chunk_sides(_identified(item_sets(df, "items")), 64)
    chunks = -(-20_000 // 64)
    sent = sum(side.agg(F.sum(F.size(c))).first()[0] for side, c in zip(sides, ("left", "right"), strict=True))
    assert sent <= chunks**2 * 2 * 64
    widest = max(side.agg(F.max(F.size(c))).first()[0] for side, c in zip(sides, ("left", "right"), strict=True))
    assert widest == 64 and all(side.rdd.getNumPartitions() > 1 for side in sides)


def test_many_frequent_items(spark):
    # two rows each for 25,000 items of which none is left out, beside one that is
    rows = spark.range(50_000).select(F.array(F.concat(F.lit("a"), (F.col("id") % 25_000).cast("string")), F.concat(F.lit("b"), (F.col("id") % 25_000).cast("string")), F.concat(F.lit("once"), F.col("id").cast("string"))).alias("items"))
    got = associations(rows, "items", min_records=2)
    assert got.count() == 25_000 and got.where("together <> 2 or n_a <> 2 or item_a like 'once%' or item_b like 'once%'").count() == 0


def test_share_of_all_rows(spark):
    rows = [(i, ["a", "b"] if i < 30 else ["a", "c"] if i < 35 else None, None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.item_a, r.item_b) for r in associations(df, "items", min_share=(1, 10)).collect()} == {("a", "b")}
    assert {(r.item_a, r.item_b) for r in associations(df, "items", min_share=(1, 60)).collect()} == {("a", "b"), ("a", "c")}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df, 8) == {} and associations(df, "items").count() == 0
    with pytest.raises(ValueError, match="chunk"):
        pair_counts(df, "items", 1)


def test_scores_and_pruning(spark):
    rnd = random.Random(2)
    rows = [(i, [f"t{int(rnd.paretovariate(0.7))}" for _ in range(4)], None) for i in range(300)] + [(i, None, None) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    every = {(r.item_a, r.item_b): r for r in associations(df, "items").collect()}
    some = {(r.item_a, r.item_b): r for r in associations(df, "items", min_records=5).collect()}
    assert some == {k: r for k, r in every.items() if r.together >= 5}
    holds = Counter(x for _, items, _ in rows for x in set(items or []))
    for (a, b), r in every.items():
        assert (r.n_a, r.n_b, r.total) == (holds[a], holds[b], 350)
        assert r.lift == pytest.approx(r.together * 350 / (holds[a] * holds[b]))
