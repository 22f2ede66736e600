import math
import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators.topn import _work, best_of, clustered, skipping_report, top_n

SCHEMA = "g string, h string, score double, rid bigint, place string"


def brute(rows, n):
    groups = {}
    for g, h, s, r, _ in rows:
        if None not in (g, h, s, r):
            groups.setdefault((g, h), []).append((math.inf if s != s else s, r))
    return sorted((g, h, i + 1, r) for (g, h), v in groups.items() for i, (_, r) in enumerate(sorted(v, key=lambda x: (-x[0], x[1]))[:n]))


def found(df, n, **how):
    return sorted((r.g, r.h, r.place, r.rid) for r in top_n(df, ["g", "h"], "score", "rid", n, **how).collect())


@pytest.mark.parametrize("n", [1, 3, 10])
def test_against_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice("abc"), rnd.choice(["x", "y", "ü"]), float(rnd.randint(0, 9)), i, "z") for i in range(3000)]
    rows += [(None, "x", 1.0, 1, "z"), ("a", None, 1.0, 1, "z"), ("a", "x", None, 1, "z"), ("a", "x", 99.0, None, "z"), ("lone", "x", 1.0, 7, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, n, row_group_bytes=1024, partitions=7) == brute(rows, n)
    assert found(df, n) == brute(rows, n)


def test_nan_ties_and_repeats(spark):
    rows = [("a", "x", float("nan"), 3, ""), ("a", "x", 5.0, 2, ""), ("a", "x", 5.0, 2, ""), ("a", "x", 5.0, 1, ""), ("a", "x", -1.0, 0, "")]
    assert found(spark.createDataFrame(rows, SCHEMA), 4) == brute(rows, 4)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA), 3) == []
    with pytest.raises(ValueError, match="n must"):
        top_n(spark.createDataFrame([], SCHEMA), ["g"], "score", "rid", 0)


def test_a_hot_group_is_skipped(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.lit("x").alias("h"), F.rand(1).alias("score"), F.col("id").alias("rid"))
    report = skipping_report(df, ["g", "h"], "score", "rid", 3, row_group_bytes=64 << 10).agg(F.sum("row_groups").alias("all"), F.sum("opened").alias("opened"), F.count(F.lit(1)).alias("files")).first()
    # the footers of all files tell the hot group's bound, so a file with lower scores only isn't opened at all
    assert report["all"] > 2 * report["files"] > 4 and report["opened"] < report["files"]
    best = [r.rid for r in df.orderBy(F.col("score").desc(), "rid").limit(3).collect()]
    assert [r.rid for r in top_n(df, ["g", "h"], "score", "rid", 3, row_group_bytes=64 << 10).orderBy("place").collect()] == best


def test_files_are_read_in_many_tasks(spark):
    df = spark.range(20_000).select((F.col("id") % 50).cast("string").alias("g"), F.lit("x").alias("h"), F.rand(1).alias("score"), F.col("id").alias("rid"))
    path = clustered(df, ["g", "h"], "score", "rid", 4096, 6)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    _, todo, number = _work(spark, path, ["g", "h"], "score", 3, kinds)
    assert number == 6 and todo.rdd.getNumPartitions() == 6
    per_task = todo.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1 and sum(r["count"] for r in per_task) == 6
    want = sorted((r.g, r.place, r.rid) for r in top_n(df, ["g", "h"], "score", "rid", 5).collect())
    assert sorted((r.g, r.place, r.rid) for r in best_of(spark, path, ["g", "h"], "score", "rid", 5, kinds).collect()) == want
