import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.llm import mixing as M

pytestmark = pytest.mark.skipif(not Path(M.VOCABULARY).exists(), reason="no vocabulary file")
DOCS = "doc_id bigint, text string, source string, tokens string, key int"
TARGETS = "source string, weight double, max_repeats int"


def docs(seed=1, n=600):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(["the", "fan", "printer", "stops", "🙂", "日本"]) for _ in range(rnd.randint(1, 60))), "big" if rnd.random() < 0.7 else rnd.choice(["mid", "small", "unlisted"]), "clash", 1) for i in range(n)]
    return rows + [(n, None, "big", "", 1), (n + 1, "", "big", "", 1), (n + 2, "text", None, "", 1), (3, rows[3][1], rows[3][2], "", 1)]


WANTED = [("big", 2.0, 1), ("mid", 2.0, 3), ("small", 1.0, 4), ("absent", 1.0, 2), ("never", 0.0, 1), (None, 5.0, 1), ("odd", None, None)]


def run(spark, rows, wanted, **how):
    chosen, report = M.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(wanted, TARGETS), **how)
    return chosen.collect(), {r.source: r for r in report.collect()}


def test_shares_caps_and_epochs(spark):
    rows = docs()
    chosen, report = run(spark, rows, WANTED)
    repeats = {s: m for s, _, m in WANTED}
    assert chosen and all(1 <= r.times <= repeats[r.source] for r in chosen)
    assert report["absent"].tokens == 0 and report["never"].tokens == 0 and report["odd"].share == 0
    for s, share in (("big", 2 / 6), ("mid", 2 / 6), ("small", 1 / 6)):
        r = report[s]
        assert r.share == pytest.approx(share) and 0.9 <= r.filled <= 1 and r.tokens == sum(c.tokens * c.times for c in chosen if c.source == s)
    by = defaultdict(set)
    for r in chosen:
        by[r.source].add(r.times)
    assert all(max(t) - min(t) <= 1 for t in by.values())


def test_against_a_plain_prefix_sum(spark):
    rows = docs(2)
    chosen, report = run(spark, rows, WANTED, total_tokens=4000)
    df = spark.createDataFrame(rows, DOCS)
    keyed = M.token_counts(df, keep={"doc_id": F.col("doc_id"), "source": F.col("source"), "key": M.sampling_key(M.quality("text"), 11, F.col("doc_id"), F.col("text"))})
    want = defaultdict(int)
    for s in ("big", "mid", "small"):
        mine = sorted((r.key, r.doc_id, r.tokens) for r in keyed.collect() if r.source == s and r.tokens)
        total, budget = sum(t for *_, t in mine), report[s].budget
        epochs, rest, so_far = budget // total, budget % total, 0
        for _, d, t in mine:
            so_far += t
            want[s, d] += epochs + (so_far <= rest)
    got = defaultdict(int)
    for r in chosen:
        got[r.source, r.doc_id] += r.times
    assert got == {k: v for k, v in want.items() if v}


def test_the_same_for_any_partitioning(spark):
    df, targets = spark.createDataFrame(docs(3), DOCS), spark.createDataFrame(WANTED, TARGETS)
    a = sorted(map(tuple, M.mix(df.repartition(1), targets, total_tokens=3000)[0].collect()))
    b = sorted(map(tuple, M.mix(df.repartition(11), targets, total_tokens=3000)[0].collect()))
    assert a == b


def test_weights_steer_the_choice(spark):
    rows = [(i, "same words in all of them", "s", "", i % 2) for i in range(4000)]
    chosen, _ = M.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("s", 1.0, 1)], TARGETS), total_tokens=2500, weight=F.when(F.col("key") == 1, 1.0).otherwise(0.1))
    odd = [r.doc_id % 2 for r in chosen.collect()]
    assert len(odd) > 300 and sum(odd) / len(odd) > 0.8


def test_useless_weights_come_last(spark):
    rows = [(i, "same words in all of them", "s", "", i) for i in range(60)]
    weight = F.when(F.col("key") < 20, 1.0).when(F.col("key") < 40, 0.0)
    chosen, report = M.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("s", 1.0, 1)], TARGETS), total_tokens=100, weight=weight)
    assert {r.doc_id for r in chosen.collect()} <= set(range(20)) and report.first().tokens == 96  # 6 tokens a document


def test_keys_are_distinct_and_follow_the_weights(spark):
    weight = F.when(F.col("id") % 2 == 0, 0.01).otherwise(0.03)
    keyed = spark.range(200_000).select("id", M.sampling_key(weight, 11, F.col("id")).alias("key"), M.sampling_key(F.lit(0.01), 11, F.col("id")).alias("same"))
    n = keyed.agg(F.count_distinct("key").alias("a"), F.count_distinct("same").alias("b")).first()
    assert n.a == n.b == 200_000
    # of the first tenth without replacement three in four or so have the threefold weight
    first = keyed.orderBy("key").limit(20_000).agg(F.avg(F.col("id") % 2)).first()[0]
    assert 0.72 < first < 0.76
    last = spark.createDataFrame([(1, 1e-12), (2, 0.0), (3, None), (4, -1.0), (5, float("nan"))], "id int, w double").select("id", M.sampling_key(F.col("w"), 11, F.col("id")).alias("key")).orderBy("key").first()
    assert last.id == 1


def test_a_total_of_the_whole_corpus(spark):
    _, report = run(spark, docs(4), WANTED, total_tokens="corpus")
    listed = [r for r in report.values() if r.available]
    assert sum(r.target for r in report.values()) <= sum(r.available for r in listed) and any(r.budget < r.target for r in listed)
    assert all(r.tokens <= r.available * dict((s, m) for s, _, m in WANTED)[r.source] for r in listed)


def test_empty(spark):
    assert run(spark, [], WANTED)[0] == []
    chosen, report = run(spark, docs(n=20), [])
    assert chosen == [] and report == {}
    assert run(spark, docs(n=20), [("big", 0.0, 1)])[0] == []


def test_tokens_are_whole(spark):
    text = "A very long text. " * 20_000
    got = M.token_counts(spark.createDataFrame([(1, text, "s", "", 1), (2, None, "s", "", 1)], DOCS)).collect()
    assert sorted(r.tokens for r in got) == [0, len(M._encoding(M.VOCABULARY).encode_ordinary(text))]
