"""Mixtures of sources in target shares of the total size in tokens, by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; within a source, the documents of smallest key are a
weighted sample without replacement. A source that must be repeated first gives whole epochs, each document once; the rest of its
budget is filled in the order of the keys up to the document that no longer fits. The running sums go over range partitions of all sources
and keys, so that no task sees a whole source.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.ranking import running_total
from feedloom.session import written

#: Fixed value: the pattern that splits text before byte pairs are merged, as the vocabulary's publisher states it.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary file where neither a parameter nor the session's setting feedloom.vocabulary names one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _token_counter(file: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(SparkFiles.get(file))
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "tokens"])

    return run


def token_counts(documents: DataFrame, text: str = "text", keep: dict[str, Column] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the length of the whole text in tokens of the vocabulary file; 0 for null.

    The file is read on the driver's side only and sent to the executors by Spark, once.
    """
    spark = documents.sparkSession
    vocabulary = vocabulary or spark.conf.get("feedloom.vocabulary", VOCABULARY)
    spark.sparkContext.addFile(vocabulary)
    part = documents.select(*[c.alias(name) for name, c in (keep or {}).items()], F.col(text).alias("_text"))
    names = [c for c in part.columns if c != "_text"]
    kinds = dict(part.dtypes)
    return part.mapInArrow(_token_counter(os.path.basename(vocabulary), names), ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "tokens bigint"]))


def quality(text: str = "text") -> Column:
    """A weight from 0.1 to 1: the share of letters and blanks in the text, lower for texts of under 200 characters; 0.1 for null and empty ones."""
    n = F.length(text)
    prose = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]", "")) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), prose * F.least(F.lit(1.0), 0.5 + n / 400)), F.lit(0.1))


def sampling_key(weight: Column, seed: int, *ids: Column) -> Column:
    """-ln(u) / weight for a u from 0 to 1 that is fixed by ``ids`` and ``seed``. Null, zero and negative weights and NaN come last, in random order."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11).cast("double") + 0.5) / float(1 << 53)
    weight = weight.cast("double")
    return F.when((weight > 0) & ~F.isnan(weight), -F.log(u) / weight).otherwise(F.lit(1e306) * (1 - F.log(u)))


def _shares(targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats), one row a source: weight over the sum of weights; null and negative weights count as 0."""
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    by = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.when(F.isnan(weight), 0.0).otherwise(weight)).alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    total = by.agg(F.sum("w")).first()[0] or 0.0
    return by.select("source", (F.col("w") / F.lit(total) if total > 0 else F.lit(0.0)).alias("share"), "max_repeats")


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> DataFrame:
    """(source, share, max_repeats, available, budget, epochs, rest) per listed source, from (source, available) ``sizes``.

    ``total_tokens`` is the size of the mixture; by default the largest in which every source that has documents reaches its share, with
    ``"corpus"`` that of all documents of listed sources. A budget beyond max_repeats times the source is cut to that.
    """
    listed = _shares(targets).join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    cap = F.col("available") * F.col("max_repeats")
    if total_tokens == "corpus":
        total_tokens = listed.agg(F.sum("available")).first()[0] or 0
    elif total_tokens is None:
        total_tokens = listed.where((F.col("share") > 0) & (cap > 0)).agg(F.floor(F.min(cap / F.col("share")))).first()[0] or 0
    b = listed.withColumn("target", F.floor(F.col("share") * F.lit(int(total_tokens)) + 1e-6).cast("bigint")).withColumn("budget", F.least("target", cap))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.greatest("available", F.lit(1)))).otherwise(0).cast("bigint")
    return b.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | str | None = None, weight: Column | None = None, seed: int = 11, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    ``chosen``: doc_id, source, tokens, times for every document that is used, ``times`` never above its source's max_repeats. ``report``: source, share,
    available, target, budget, documents, uses, tokens, reached (of all tokens chosen) and filled (of the target), one row per listed source.

    Documents of sources that aren't listed, or with a null source or no tokens, aren't used; a source without documents reaches
    0 and its part of the total stays empty; weight 0 gives none. Keys depend on id and text, so equal rows stand side by side and are chosen in any
    order. Empty tables give an empty mixture.
    """
    w = weight if weight is not None else quality(text)
    keep = {"doc_id": F.col(doc_id), "source": F.col(source), "key": sampling_key(w, seed, F.col(doc_id), F.col(text))}
    sized = written(token_counts(documents.where(F.col(source).isNotNull()), text, keep, vocabulary).where(F.col("tokens") > 0), "tokens")
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = written(budgets(totals, targets, total_tokens), "budgets")
    wanted = plan.where(F.col("budget") > 0).select("source", "epochs", "rest")
    mine = sized.join(wanted, "source")
    # one running total over all sources, less what the sources before have
    ends = running_total(totals.join(wanted.select("source"), "source"), [F.col("source")], F.col("available"), "end_")
    starts = ends.select("source", (F.col("end_") - F.col("available")).alias("start_"))
    placed = running_total(mine, [F.col(c) for c in ("source", "key", "doc_id", "tokens")], F.col("tokens"), "upto").join(starts, "source")
    more = (F.col("upto") - F.col("start_") <= F.col("rest")).cast("bigint")
    chosen = placed.withColumn("times", F.col("epochs") + more).where(F.col("times") > 0).select("doc_id", "source", "tokens", "times")
    chosen = written(chosen, "mixture")
    return chosen, reached(chosen, plan)


def reached(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """The report of ``mix``."""
    by = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("times").alias("uses"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    total = chosen.agg(F.sum(F.col("tokens") * F.col("times"))).first()[0] or 0
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    r = plan.join(by, "source", "left").select("source", "share", "available", "target", "budget", z("documents"), z("uses"), z("tokens"))
    return r.withColumns({"reached": F.col("tokens") / F.lit(float(max(total, 1))), "filled": F.when(F.col("target") > 0, F.col("tokens") / F.col("target"))})
