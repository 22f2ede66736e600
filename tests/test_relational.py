from pyspark.sql import functions as F

from feedloom.operators import ranking
from feedloom.operators import relational as rel


def test_keep_first(spark):
    df = spark.createDataFrame([(2, 1, "B"), (1, 1, "A"), (3, 2, None), (4, None, "x"), (5, None, "y"), (1, 1, "A")], "ord int, id int, title string")
    got = sorted(rel.keep_first(df, ["id"], "ord").collect(), key=repr)
    assert {(r.id, r.ord, r.title) for r in got} == {(1, 1, "A"), (2, 3, None), (None, 4, "x")}
    assert rel.keep_first(df.limit(0), ["id"], "ord").count() == 0


def test_keep_first_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.lit(5000) - F.col("id")).alias("ord"), F.col("id").alias("v"))
    want = {r.k: r.v for r in rel.keep_first(df, ["k"], "ord").collect()}
    for n in (1, 3, 16):
        assert {r.k: r.v for r in rel.keep_first(df.repartition(n, "v"), ["k"], "ord").collect()} == want


def test_left_lookup(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "id int")
    table = spark.createDataFrame([(1, "one"), (1, "uno"), (None, "none"), (3, None)], "id int, name string")
    got = rel.left_lookup(df, table, "id", "name", F.lit("Unknown"), "name").collect()
    assert sorted((r.id or 0, r.name) for r in got) == [(0, "Unknown"), (1, "one"), (2, "Unknown"), (3, "Unknown")]


def test_flagged(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    members = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    got = rel.flagged(df, members, "id", "yes").collect()
    assert sorted((r.id or 0, r.yes) for r in got) == [(0, False), (1, True), (2, False)]


def test_distribution(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, None)], "ord int, k string")
    got = {r.k: (r.n, r.pct, r.first) for r in rel.distribution(df, "k", "ord").collect()}
    assert got == {"a": (1, 25.0, 0), "b": (2, 50.0, 1), None: (1, 25.0, 3)}
    assert rel.distribution(df.limit(0), "k", "ord").count() == 0


def test_exploded_counts_and_dimension(spark):
    df = spark.createDataFrame([(0, ["x", "y", "x"]), (1, ["y"]), (2, []), (3, None)], "ord int, t array<string>")
    got = {r.item: (r.n, tuple(r.first)) for r in rel.exploded_counts(df, "t", "ord").collect()}
    assert got == {"x": (2, (0, 0)), "y": (2, (0, 1))}
    dim = spark.createDataFrame([(0, "zero"), (9, "nine")], "ord int, name string")
    assert {r.name: r.n for r in rel.counts_of_all(dim, df, "ord").collect()} == {"zero": 1, "nine": 0}


def test_inverted_index(spark):
    df = spark.createDataFrame([(5, "five", ["c"]), (2, "two", ["c", "c"]), (9, "nine", None)], "o int, title string, codes array<string>")
    got = [(r.item, r.postings, r.first.title) for r in rel.inverted_index(df, "codes", [F.col("o")], ["title"]).collect()]
    assert got == [("c", 3, "two")]


def test_percentile_score(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "raw double")
    got = sorted(r.s for r in ranking.percentile_score(df, F.col("raw"), "s").collect())
    assert got == [0.0, 2.5, 2.5, 7.5]
    many = spark.range(500).select((F.col("id") % 37).cast("double").alias("raw"))
    raws = sorted(i % 37 for i in range(500))
    want = {v: sum(x < v for x in raws) / 500 * 10 for v in set(raws)}
    assert all(abs(r.s - want[r.raw]) <= 0.0500001 for r in ranking.percentile_score(many, F.col("raw"), "s").collect())
    assert ranking.percentile_score(df.limit(0), F.col("raw"), "s").count() == 0
    nulls = spark.createDataFrame([(None,), (1.0,)], "raw double")
    assert {r.raw: r.s for r in ranking.percentile_score(nulls, F.col("raw"), "s").collect()} == {None: 0.0, 1.0: 5.0}


def test_numbered_and_running_total(spark):
    df = spark.range(1000).select(F.col("id"), ((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 10).alias("a")).repartition(9)
    assert all(r.place == r.k + 1 for r in ranking.numbered(df, [F.col("k").asc()], "place").collect())
    rows = sorted(ranking.running_total(df, [F.col("k").asc()], F.col("a"), "sum_").collect(), key=lambda r: r.k)
    total = 0
    for r in rows:
        total += r.a
        assert r.sum_ == total
    assert ranking.numbered(df.limit(0), [F.col("k").asc()], "place").count() == 0
