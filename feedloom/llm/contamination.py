"""Test passages inside training documents, found with suffix arrays over shards of the corpus.

Each task turns its documents, shard by shard, into one array of words and sorts all its suffixes. Every suffix of
every test passage is then binary-searched in the shard, all of them a word deeper at a time, which gives the places of its
longest verbatim matches. The array of a shard is made once; passages beyond the memory of a task stand in blocks in the shared
folder, which it takes one after the other. Where a match is long enough to be part of a quote with a tenth of its
words altered, it is extended over changed, dropped and added words to both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.textarrays import classes, code_points, lowered, span_hashes
from feedloom.session import new_path, open_shared, written

#: Tags, whose attributes have values, and entities, which are no words.
MARKUP = r"""</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z_:][-A-Za-z0-9_:.]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))*\s*/?>|&[A-Za-z]+;|&#\d+;"""
_SHARD_POINTS = 4_000_000


def plain(text: str | Column) -> Column:
    """Text without tags and entities, in lower case, with ``ß`` as ``ss``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.replace(F.lower(F.regexp_replace(c, MARKUP, " ")), F.lit("ß"), F.lit("ss"))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text it is in). Words are runs of letters and digits, or one letter of a script without blanks; invisible characters don't count."""
    points, offsets = code_points(column)
    kinds = classes(points)
    seen = (kinds & 16) == 0
    if not seen.all():
        offsets = np.concatenate([[0], np.cumsum(seen)])[offsets]
        points, kinds = points[seen], kinds[seen]
    word, lone = (kinds & 3) > 0, (kinds & 8) > 0
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = word.copy(), word.copy()
    if len(points):
        edge = lone[1:] | lone[:-1] | (row[1:] != row[:-1])
        first[1:] &= ~word[:-1] | edge
        last[:-1] &= ~word[1:] | edge
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(lowered(points), starts, ends), row[starts] if len(points) else starts


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` sorted by what follows, up to ``depth`` places, by prefix doubling; only ties are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    group = np.searchsorted(at, at)  # first place of each group of ties
    rank = np.empty(n, np.int64)
    rank[order] = group
    k = 1
    open_ = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)  # places in the order that are tied
    while k < depth and len(open_):
        where = order[open_]
        follow = where + k
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        first = rank[where]
        again = np.lexsort((second, first))
        where, first, second = where[again], first[again], second[again]
        order[open_] = where  # groups are contiguous and keep their places
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        place = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        rank[where] = place
        size = np.bincount(np.cumsum(new) - 1)
        open_ = open_[size[np.cumsum(new) - 1] > 1]
        k *= 2
    return order


def longest_matches(ids: np.ndarray, sa: np.ndarray, query: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, corpus position, length) of the verbatim matches of ``least`` words or more that go on to neither side.

    ``query`` holds word ids (negative: not in this shard), ``left`` how many words each of its positions has to its passage's end.
    """
    n = len(ids)
    padded = np.append(ids, -2)
    at = np.flatnonzero((left >= least) & (query >= 0))
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n)
    for d in range(least):
        word = query[at + d]
        bounds = []
        for upper in (False, True):
            a, b = lo.copy(), hi.copy()
            while len(a) and (b > a).any():
                mid = (a + b) >> 1
                value = padded[np.minimum(sa[np.minimum(mid, n - 1)] + d, n)]
                right = (value <= word) if upper else (value < word)
                go = b > a
                a = np.where(go & right, mid + 1, a)
                b = np.where(go & ~right, mid, b)
            bounds.append(a)
        lo, hi = bounds
        some = (hi > lo) & (word >= 0)
        at, lo, hi = at[some], lo[some], hi[some]
        if not len(at):
            return at, at, at
    count = hi - lo
    q = np.repeat(at, count)
    c = sa[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    before_q, before_c = np.where(q > 0, query[np.maximum(q - 1, 0)], -3), np.where(c > 0, ids[np.maximum(c - 1, 0)], -4)
    first = (before_q != before_c) | (before_q < 0) | (np.append(0, left[:-1])[q] != left[q] + 1)
    q, c = q[first], c[first]
    length = np.full(len(q), least)
    grow = np.arange(len(q))
    while len(grow):
        more = left[q[grow]] > length[grow]
        grow = grow[more]
        same = query[q[grow] + length[grow]] == padded[np.minimum(c[grow] + length[grow], n)]
        grow = grow[same & (query[q[grow] + length[grow]] >= 0)]
        length[grow] += 1
    return q, c, length


def extend(passage: list[int], text: list[int], most: int) -> list[int]:
    """For 0, 1, ... ``most`` edits, how many words of ``passage`` from its start are found from the start of ``text``, the last of them unchanged."""
    n, m = len(passage), len(text)
    out, best = [], 0
    front: dict[int, int] = {}
    for e in range(most + 1):
        new: dict[int, int] = {}
        for k in range(-e, e + 1):  # k: text place minus passage place
            if e == 0:
                i = 0
            else:
                i = max(front.get(k, -9) + 1, front.get(k + 1, -9) + 1, front.get(k - 1, -9))
                if i < 0:
                    continue
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            from_ = i
            while i < n and i + k < m and passage[i] == text[i + k]:
                i += 1
            new[k] = i
            if i > from_:
                best = max(best, i)
        front = new
        out.append(best)
        if best >= n:
            out += [n] * (most - e)
            break
    return out


def best_stretch(passage: np.ndarray, text: np.ndarray, q: int, c: int, length: int, per_edit: int) -> tuple[int, int]:
    """(words, edits) of the longest stretch around a verbatim match with one edit in ``per_edit`` words at most; of the text only what a stretch can reach is looked at."""
    most = len(passage) // per_edit + 1
    slack = len(passage) + most
    right = extend(passage[q + length :].tolist(), text[c + length : c + length + slack].tolist(), most)
    left = extend(passage[:q][::-1].tolist(), text[max(0, c - slack) : c][::-1].tolist(), most)
    found = (length, 0)
    for a, x in enumerate(left):
        for b, y in enumerate(right):
            total = length + x + y
            if (a + b) * per_edit <= total and total > found[0]:
                found = (total, a + b)
    return found


#: A window of passage words around a run and the words of it that may be missing from the text; see ``may_reach``.
_WINDOW, _MISSING = 13, 3


def may_reach(passage: np.ndarray, text: np.ndarray, q: int, length: int) -> bool:
    """Whether the run at ``q`` can be part of 15 words or more with an edit in ten at most: a window of 13 words over it of which the text lacks three at most.

    Each passage word that the text lacks is an edit. Were there four in every window over every run of six words or more of such a stretch,
    its runs would have nine words at most and four edits on a side, so n words would have e edits with n <= 8 e + 5, against n >= 10 e
    and e >= 4. So some run of each stretch passes, which is enough to find it.
    """
    absent = np.concatenate([[0], np.cumsum(~np.isin(passage, text))])
    n = min(_WINDOW, len(passage))
    a, b = max(0, q + length - n), min(q, len(passage) - n)
    starts = np.arange(min(a, b), max(a, b) + 1)
    return bool((absent[starts + n] - absent[starts]).min() <= _MISSING)


_BLOCK = "block int, pid bigint, hashes array<bigint>"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, row = words(b.column("p"))
        bounds = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("pid"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))], names=["block", "pid", "hashes"])


class _Passages:
    """A block of distinct passages as word hashes, from the files of the block."""

    def __init__(self, files: tuple[str, ...]):
        tables = []
        for path in files:
            with open_shared(path) as source:
                tables.append(pq.ParquetFile(source).read(columns=["pid", "hashes"]))
        table = pa.concat_tables(tables).combine_chunks()
        lists = table.column("hashes").combine_chunks()
        self.pid = table.column("pid").to_numpy()
        self.hashes, self.row = lists.flatten().to_numpy().view(np.uint64), lists.value_parent_indices().to_numpy().astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=len(table)))])
        self.left = self.first[1:][self.row] - np.arange(len(self.row))


@lru_cache(maxsize=1)
def _block(files: tuple[str, ...]) -> _Passages:
    """The block read last is kept: where there is only one, a task's process reads it once."""
    return _Passages(files)



_FOUND = "pid bigint, doc_id bigint, longest_verbatim int, words int, edits int, at_word int"


class _Shard:
    """Some documents as one array of word ids with all its suffixes sorted."""

    def __init__(self, text: pa.Array, depth: int):
        hashes, row = words(text)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))])
        # a word that no passage has stands after each document, so that no match crosses its end
        self.stream = np.full(len(ids) + len(text), len(self.vocabulary))
        self.stream[np.arange(len(ids)) + row] = ids
        self.starts = self.bounds[:-1] + np.arange(len(text))
        self.order = suffix_array(self.stream, depth)

    def search(self, p: _Passages, least: int, per_edit: int, seed: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(pid, document, longest_verbatim, words, edits, at_word) of the passages found."""
        if not len(self.vocabulary):
            return
        found = np.minimum(np.searchsorted(self.vocabulary, p.hashes), len(self.vocabulary) - 1)
        query = np.where(self.vocabulary[found] == p.hashes, found, -1)
        q, c, length = longest_matches(self.stream, self.order, query, p.left, min(seed, least))
        doc = np.searchsorted(self.starts, c, side="right") - 1
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for i in np.lexsort((-length, doc)):
            passage, d, run = int(p.row[q[i]]), int(doc[i]), int(length[i])
            have = best.get((passage, d), (0, 0, 0, 0))
            a, b = p.first[passage], p.first[passage + 1]
            if have[1] >= b - a:
                continue
            text = self.stream[self.starts[d] : self.starts[d] + self.bounds[d + 1] - self.bounds[d]]
            at, where = int(q[i] - a), int(c[i] - self.starts[d])
            near = text[max(0, where - 2 * (b - a)) : where + run + 2 * (b - a)]
            if run < least and least >= 15 and per_edit >= 10 and not may_reach(query[a:b], near, at, run):
                continue
            n, edits = best_stretch(query[a:b], text, at, where, run, per_edit)
            best[(passage, d)] = max(have, (max(have[0], run), n, -edits, where), key=lambda x: (x[1], x[2])) if n > have[1] else (max(have[0], run), *have[1:])
        for (passage, d), (run, n, minus, at) in best.items():
            if n >= least:
                yield int(p.pid[passage]), d, run, n, -minus, at


def _searcher(blocks: list[tuple[str, ...]], depth: int, least: int, per_edit: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, doc_ids = b.column("text"), b.column("doc_id")
            size = np.cumsum(np.diff(np.frombuffer(text.cast(pa.large_string()).buffers()[1], np.int64, len(text) + 1)) if len(text) else [])
            cuts = np.flatnonzero(np.diff(size // _SHARD_POINTS, prepend=-1)) if len(text) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(text)], strict=True):
                shard = _Shard(text.slice(lo, hi - lo), depth)
                for files in blocks:
                    rows = list(shard.search(_block(files), least, per_edit, seed))
                    if rows:
                        pid, doc, *rest = (np.array(v) for v in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(pid), doc_ids.take(pa.array(lo + doc)), *(pa.array(v.astype(np.int32)) for v in rest)], names=["pid", "doc_id", "longest_verbatim", "words", "edits", "at_word"])

    return search


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least: int = 15, per_edit: int = 10, seed: int = 6, block_chars: int = 4_000_000) -> DataFrame:
    """(item_id, doc_id, longest_verbatim, words, edits, at_word) for every document that holds ``least`` words in a row of an item's passage.

    Of the words at most one in ``per_edit`` is changed, dropped or added; ``words`` is the longest such stretch found, ``at_word`` the place in the document of a verbatim
    part. A quote with an edit per ten words has six words untouched somewhere, so ``seed`` 6 loses none.
    Ids are bigints. Null or empty texts and passages of fewer than ``least`` words match nothing; items with the same passage are all
    given, by a join, however many they are; copies of a document, with the same id or not, are searched each.

    Distinct passages are written in blocks of about ``block_chars`` characters; the driver only knows the paths. The documents are read
    and the suffix array of each shard made once, whatever the number of blocks.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_id).cast("bigint").alias("item_id"), plain(passage).alias("p")).where(F.col("p").isNotNull() & (F.col("p") != ""))
    wanted = written(wanted, "items")
    distinct = written(wanted.select("p").distinct().withColumn("pid", F.monotonically_increasing_id()), "passages")
    sizes = distinct.agg(F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length("p")), F.lit(0)).alias("longest")).first()
    number = max(1, -(-sizes.chars // block_chars))
    path = new_path(spark, "blocks")
    spread = distinct.withColumn("block", F.pmod(F.xxhash64("p"), F.lit(number)).cast("int")).mapInArrow(_hashed, _BLOCK).where(F.size("hashes") >= least)
    spread.repartition(min(number, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").write.partitionBy("block").parquet(path)
    # the schema is stated, as no passage may be long enough and nothing written
    listed = spark.read.schema(_BLOCK).parquet(path).select("block", F.input_file_name().alias("file")).distinct().orderBy("block", "file").collect()
    blocks = [tuple(r.file for r in rows) for _, rows in groupby(listed, key=lambda r: r.block)]
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), plain(text).alias("text"))
    found = corpus.mapInArrow(_searcher(blocks, int(sizes.longest), least, per_edit, seed), _FOUND)
    return found.join(distinct, "pid").join(wanted, "p").select("item_id", "doc_id", "longest_verbatim", "words", "edits", "at_word")


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no test passage; those without an id (null) stay."""
    return documents.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, documents, longest_verbatim) of every item that leaked."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("longest_verbatim").alias("longest_verbatim"))
