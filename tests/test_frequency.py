from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.operators.frequency import marked_terms, scan_runs, term_frequencies

SCHEMA = "record_id bigint, a array<string>, b array<string>, term string, records string"


def brute(rows):
    occ, rec = Counter(), defaultdict(set)
    for rid, a, b, *_ in rows:
        for field, values in (("a", a), ("b", b)):
            for v in values or []:
                t = None if v is None else v.strip(" \t").lower()
                if t:
                    occ[field, t] += 1
                    rec[field, t].add(rid)
    return {k: (n, len(rec[k])) for k, n in occ.items()}


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.field_name, r.term): (r.occurrences, r.records) for r in term_frequencies(df, ["a", "b"], **how).collect()}


def test_against_brute_force(spark):
    rows = [(i, [f"t{i % 7}", "Hot ", "hot", None, "", " \t"], None if i % 3 else [f"\tV{i}"], "x", "y") for i in range(400)]
    rows += [(None, ["hot"], [], None, None), (None, ["hot"], None, None, None), (5, ["hot"], ["hot"], "", "")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, partitions=13) == brute(rows)


def test_empty_and_long(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, [], None, None, None), (2, None, None, None, None)]) == {}
    long = "ä" * 100_000
    assert found(spark, [(1, [long, long.upper()], None, None, None)]) == {("a", long): (2, 1)}


def test_ids_of_any_type(spark):
    rows = [("", ["x"]), (None, ["x"]), (None, ["x"]), ("1", ["x"]), ("1", ["x"])]
    df = spark.createDataFrame(rows, "record_id string, a array<string>")
    ids = {"string": "record_id", "double": "try_cast(record_id as double)", "struct": "struct(record_id)", "date": "case when record_id = '1' then date '2020-01-01' end"}
    got = {k: (r := term_frequencies(df.selectExpr(f"{v} as record_id", "a"), ["a"], partitions=3).first()).records + 10 * r.occurrences for k, v in ids.items()}
    assert got == {"string": 53, "double": 52, "struct": 53, "date": 52}


def test_one_term_holds_all_rows(spark):
    rows = [(i, ["x"], ["x", "x"], None, None) for i in range(5000)]
    assert found(spark, rows, partitions=8) == {("a", "x"): (5000, 5000), ("b", "x"): (10000, 5000)}


def test_marks(spark):
    rows = [(i, ["all"] + (["two"] if i < 2 else []) + (["tenth"] if i < 4 else []), [], None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.term: r.mark for r in marked_terms(df, ["a"]).collect()} == {"all": "common", "two": "rare", "tenth": None}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(0, 3)), max_size=40), st.integers(1, 7))
def test_scan_over_batch_borders(pairs, size):
    pairs = sorted(pairs)
    batches = [pa.RecordBatch.from_pylist([{"field_name": f, "term": t, "rid": r} for f, t, r in pairs[i : i + size]]) for i in range(0, len(pairs), size)]
    occ, rec = Counter(), Counter()
    for b in scan_runs(iter(batches)):
        for row in b.to_pylist():
            occ[row["field_name"], row["term"]] += row["occurrences"]
            rec[row["field_name"], row["term"]] += row["records"]
    assert occ == Counter((f, t) for f, t, _ in pairs)
    assert rec == Counter((f, t) for f, t, _ in set(pairs))
