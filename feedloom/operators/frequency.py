"""Occurrences and record counts of every distinct term: external sort, then run-length scanning.

(term, record) pairs are range-partitioned on the whole pair, so that a term held by a third of all rows
is spread over many partitions, and sorted within each partition (Spark spills where memory ends). A scan
of the sorted pairs turns each run into one row; the few runs that a partition border cut are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.terms import terms

#: Types of ids that are compared as they are; others by their JSON.
_PLAIN = (T.IntegralType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
_RUN = "field_name string, term string, occurrences bigint, records bigint"


def term_pairs(df: DataFrame, fields: list[str], record_id: str) -> DataFrame:
    """One row (field_name, term, rid) per occurrence of a term in a field of a record."""
    tag = lambda f: F.transform(terms(f, distinct=False), lambda t: F.struct(F.lit(f).alias("field_name"), t.alias("term")))
    tagged = F.flatten(F.array(*[tag(f) for f in fields]))
    return df.select(F.explode(tagged).alias("t"), F.col(record_id).alias("rid")).select("t.field_name", "t.term", "rid")


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; null differs from every value but null."""
    if len(column) < 2:
        return np.zeros(max(0, len(column) - 1), bool)
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.not_equal(here, before)
    return (pc.fill_null(differ, pc.not_equal(here.is_null(), before.is_null())) if column.null_count else differ).to_numpy(zero_copy_only=False)


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (field_name, term, rid) batches.

    Gives a row per run and batch; a record that goes on from the batch before isn't counted again.
    """
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        field, term, rid = b.column("field_name"), b.column("term"), b.column("rid")
        new_term = np.concatenate([[True], _changes(field) | _changes(term)])
        new_record = np.concatenate([[True], _changes(rid)]) | new_term
        if last == (field[0], term[0], rid[0]):
            new_record[0] = False
        last = (field[-1], term[-1], rid[-1])
        starts = np.flatnonzero(new_term)
        yield pa.RecordBatch.from_arrays(
            [
                field.take(pa.array(starts)),
                term.take(pa.array(starts)),
                pa.array(np.diff(np.append(starts, b.num_rows))),
                pa.array(np.add.reduceat(new_record.astype(np.int64), starts)),
            ],
            names=["field_name", "term", "occurrences", "records"],
        )


def term_frequencies(df: DataFrame, fields: list[str], record_id: str = "record_id", partitions: int | None = None) -> DataFrame:
    """(field_name, term, occurrences, records) for every distinct term of the array columns ``fields``.

    A record is a row; ``record_id``, of any type, tells records apart, so rows that repeat an id count as one record and
    rows without an id (null) together as one, apart from that of an empty id. Null arrays, null elements and empty terms count
    nowhere; an element repeated within a row counts per occurrence but once as a record. An empty table
    gives no rows. Columns besides ``fields`` and ``record_id`` are ignored, whatever their names.
    """
    pairs = term_pairs(df, fields, record_id)
    if not isinstance(df.schema[record_id].dataType, _PLAIN):
        pairs = pairs.withColumn("rid", F.when(F.col("rid").isNotNull(), F.to_json(F.struct("rid"))))
    keys = ["field_name", "term", "rid"]
    sorted_pairs = (pairs.repartitionByRange(partitions, *keys) if partitions else pairs.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    runs = sorted_pairs.mapInArrow(scan_runs, _RUN)
    return runs.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def usefulness(records: str | Column, total: int, rare_at_most: int = 2, common_share: tuple[int, int] = (1, 10)) -> Column:
    """``rare`` up to ``rare_at_most`` records, else ``common`` above the share of all ``total`` rows, else null."""
    n = F.col(records) if isinstance(records, str) else records
    return F.when(n <= rare_at_most, "rare").when(n * common_share[1] > F.lit(total).cast("bigint") * common_share[0], "common")


def marked_terms(df: DataFrame, fields: list[str], record_id: str = "record_id", **marks) -> DataFrame:
    """``term_frequencies`` with the column ``mark`` (rare, common or null) against the number of rows of ``df``."""
    return term_frequencies(df, fields, record_id).withColumn("mark", usefulness("records", df.count(), **marks))
