"""Top N rows of every group by statistics-guided skipping.

Rows are clustered into files by (group, score descending, tie-break) with range partitioning, which splits
a hot group over many files. The footers tell each row group's best score, whether it holds one group
only and, if it has N rows or more, a score that N rows of that group reach. The best such score of all files is the
group's bound, so that row groups strictly below it are left out before any is opened. Each task then takes
the rest of a file's row groups in descending maximum score and skips those strictly below the current N-th score
of every group they hold. A row group of several groups holds the start, so the best rows, of its last one: it is skipped
only if that group is known to be complete, which small groups never are, and is else read in one pass.
What survives is at most N rows per group and row group read, of which a window picks the N.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from feedloom.session import new_path, open_shared, written


def _footer_reader(keys: list[str], score: str, n: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with open_shared(path) as source:
                    meta = pq.ParquetFile(source).metadata
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                rows = []
                for r in range(meta.num_row_groups):
                    stats = {c: meta.row_group(r).column(at[c]).statistics for c in [*keys, score]}
                    known = {c: s is not None and s.has_min_max for c, s in stats.items()}
                    single = all(known[k] and stats[k].min == stats[k].max for k in keys)
                    top = float(stats[score].max) if known[score] else np.inf
                    floor = float(stats[score].min) if known[score] and single and meta.row_group(r).num_rows >= n else None
                    rows.append({"path": path, "row_group": r, "top": top, "floor": floor, **{k: stats[k].min if single else None for k in keys}})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def footers(df_files: DataFrame, keys: list[str], score: str, n: int, kinds: dict[str, T.DataType]) -> DataFrame:
    """(path, row_group, top, floor, keys) from the footers alone: the best score of each row group, without statistics infinite; the keys
    of its only group, null where it holds several; and its lowest score if ``n`` rows of that group or more are in it, else null."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row_group", T.LongType()), T.StructField("top", T.DoubleType()), T.StructField("floor", T.DoubleType()), *(T.StructField(k, kinds[k]) for k in keys)])
    return df_files.mapInArrow(_footer_reader(keys, score, n, to_arrow_schema(schema)), schema)


def _runs(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys start."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _reader(keys: list[str], score: str, n: int, tally: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads (path, todo) rows, ``todo`` being the file's row groups that are left, in descending maximum, as (minus top, row_group, keys)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.to_pylist():
                opened = 0
                only_of = [None if any(x[k] is None for k in keys) else tuple(x[k] for k in keys) for x in file["todo"]]
                best: dict[tuple, list[float]] = {g: [] for g in only_of if g is not None}
                with open_shared(file["path"]) as source:
                    parquet = pq.ParquetFile(source)
                    for x, only in zip(file["todo"], only_of, strict=True):
                        if only is not None and len(best[only]) == n and -x["minus_top"] < best[only][0]:
                            continue
                        opened += 1
                        rows = parquet.read_row_group(x["row_group"])
                        starts = _runs(rows, keys)
                        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
                        firsts = rows.filter(pa.array(place < n))
                        scores, heads = rows.column(score).to_numpy(), zip(*(rows.column(k).take(pa.array(starts)).to_pylist() for k in keys), strict=True)
                        for start, end, group in zip(starts, np.append(starts[1:], len(rows)), heads, strict=True):
                            if (heap := best.get(group)) is not None:
                                for s in scores[start : min(end, start + n)]:
                                    (heapq.heappush if len(heap) < n else heapq.heappushpop)(heap, np.inf if np.isnan(s) else s)
                        if not tally:
                            yield from firsts.to_batches()
                if tally:
                    yield pa.RecordBatch.from_pydict({"path": [file["path"]], "opened": pa.array([opened], pa.int64())})

    return read


def clustered(df: DataFrame, keys: list[str], score: str, tie: str, row_group_bytes: int, partitions: int | None = None) -> str:
    """Writes ``df`` clustered by group and descending score to the shared folder; gives the path, to be used for any N.

    The number of files is stated, by default that of shuffle partitions, so that no merging of small partitions makes few of them.
    """
    spark = df.sparkSession
    path = new_path(spark, "clustered")
    order = [*[F.col(k).asc() for k in keys], F.col(score).desc(), F.col(tie).asc()]
    spread = df.repartitionByRange(partitions or _default_partitions(spark), *order)
    spread.sortWithinPartitions(*order).write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", max(1024, row_group_bytes // 8)).parquet(path)
    return path


def _default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The clustered files' paths, a task for each, and their number; their content isn't read here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    n = max(1, files.count())
    return files.repartition(n), n


def _complete(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The columns that count, without rows that have a null in one; NaN stays."""
    part = df.select(*keys, score, tie)
    return part.where(reduce(and_, [F.col(c).isNotNull() for c in part.columns])).withColumn(score, F.col(score).cast("double"))


def _work(spark: SparkSession, path: str, keys: list[str], score: str, n: int, kinds: dict[str, T.DataType]) -> tuple[DataFrame, DataFrame, int]:
    """(footers, (path, todo) of the files with row groups left, number of files)."""
    files, number = _files(spark, path)
    known = written(footers(files, keys, score, n, kinds), "footers")
    bounds = known.where(F.col("floor").isNotNull()).groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.max("floor").alias("bound"))
    left = known.join(bounds, reduce(and_, [known[k] == bounds[f"_{i}"] for i, k in enumerate(keys)]), "left").where(F.col("bound").isNull() | (F.col("top") >= F.col("bound")))
    todo = left.groupBy("path").agg(F.sort_array(F.collect_list(F.struct((-F.col("top")).alias("minus_top"), "row_group", *keys))).alias("todo"))
    return known, todo.repartition(number), number


def best_of(spark: SparkSession, path: str, keys: list[str], score: str, tie: str, n: int, kinds: dict[str, T.DataType]) -> DataFrame:
    """``top_n`` of a ``clustered`` table; ``kinds`` are the types of its columns."""
    _, todo, _ = _work(spark, path, keys, score, n, kinds)
    schema = T.StructType([T.StructField(c, T.DoubleType() if c == score else kinds[c]) for c in [*keys, score, tie]])
    survivors = todo.mapInArrow(_reader(keys, score, n, tally=False), schema)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc()))
    return survivors.withColumn("place", place).where(F.col("place") <= n)


def top_n(df: DataFrame, keys: list[str], score: str, tie: str, n: int = 3, row_group_bytes: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """The ``n`` rows of highest ``score`` of every group, ties by ascending ``tie``; ``place`` counts from 1.

    Columns: keys, score (as double), tie, place; others of ``df`` aren't carried. Rows with a null key, score or tie take
    no part. NaN counts above every number, as in Spark's order. Groups with fewer rows give
    all they have; rows equal in keys, score and tie are kept as often as they occur. An empty table gives no rows.
    Row groups of a size well below that of a large group let the reader skip more.
    """
    if n < 1:
        raise ValueError("n must be 1 at least")
    part = _complete(df, keys, score, tie)
    path = clustered(part, keys, score, tie, row_group_bytes, partitions)
    return best_of(df.sparkSession, path, keys, score, tie, n, {f.name: f.dataType for f in part.schema.fields})


def skipping_report(df: DataFrame, keys: list[str], score: str, tie: str, n: int = 3, row_group_bytes: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """(path, row_groups, opened) of each clustered file: how much the statistics let the reader skip."""
    part = _complete(df, keys, score, tie)
    path = clustered(part, keys, score, tie, row_group_bytes, partitions)
    known, todo, _ = _work(df.sparkSession, path, keys, score, n, {f.name: f.dataType for f in part.schema.fields})
    opened = todo.mapInArrow(_reader(keys, score, n, tally=True), "path string, opened bigint")
    every = known.groupBy("path").agg(F.count(F.lit(1)).alias("row_groups"))
    return every.join(opened, "path", "left").withColumn("opened", F.coalesce("opened", F.lit(0)).cast("bigint"))
