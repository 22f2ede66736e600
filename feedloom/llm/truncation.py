"""Texts that lost their end: length hazards by source, and endings judged by what the corpus says after them.

1. For every table and source the hazard of each length (texts that end there over texts that get there) is compared, in
   characters and in bytes and at several widths, with the hazards around it; the false-discovery rate
   is controlled within each source.
2. At a significant length an ending is a cut (``by`` limit) unless it is closed or the corpus knows it as a finished one.
3. A cut in mid-transfer has no significant length. Elsewhere only endings are cuts (``by`` mid-transfer) that stop at half a
   character or an open mark, or that the corpus practically never finishes.

What the corpus says about an ending: after its last words, how often does a sentence end, go on, or the last word itself go on?
All texts are counted for it, in passes over bounded blocks of the endings asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.textarrays import classes, code_points, is_in, lowered, mixed, prefix_sums, span_hashes
from feedloom.session import written

#: What feeds put after a break, at the end of a text, and the line after which mail adds its own.
MARKER = r"(\[\s*(?:…|\.\.\.)\s*\]|…|\.\.\.)$"
TRAILER = r"\n--[ \t]*\n[^\n]*\s*$"
#: A letter or mark as ``classes`` has them.
LETTER = r"[[\p{L}\p{M}]&&[\x{0}-\x{FFFF}\x{20000}-\x{31FFF}]]"
CLOSING = ".!?。！？…"
CLOSERS = "\"')]}»”’」』）"
WHITE = " \t\n\u000b\f\r"

WIDTHS = (1, 4, 16)
_UNITS = ("chars", "bytes", "body_chars")
#: Rows whose arrays are made at once: small enough to stay in a core's cache.
_ROWS = 500
_NEIGHBOURS = 12
#: Bits of the filter of a block of endings, and bits for each of its hashes.
_BLOCK_BITS, _BITS_EACH = 1 << 28, 16


def prepared(df: DataFrame, table_name: str, record_id: str, text: str, source: str) -> DataFrame:
    """(table_name, record_id, source, text, body, marker): the text without a mail trailer, and also without a marker, each of any length. Null texts and texts of white space go."""
    rows = df.select(F.lit(table_name).alias("table_name"), F.col(record_id).alias("record_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    # the patterns of an end run only where its signs are
    less = F.expr(f"left(text, length(text) - length(regexp_extract(text, r'{TRAILER}', 0)))")
    rows = rows.withColumn("text", F.when(F.contains("text", F.lit("\n--")), less).otherwise(F.col("text")))
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    ends = stripped.endswith("…") | stripped.endswith("...") | stripped.endswith("]")
    rows = rows.withColumn("marker", F.when(ends, F.regexp_extract(stripped, MARKER, 1)).otherwise(F.lit("")))
    unmarked = F.rtrim(F.left(stripped, F.length(stripped) - F.length("marker")), F.lit(WHITE))
    body = F.when(F.col("marker") == "", F.rtrim("text")).otherwise(unmarked)
    return rows.withColumn("body", body).where(F.length("body") > 0)


# --- hazards -----------------------------------------------------------------------------------------------------


def length_hazards(lengths: DataFrame, false_discovery: float = 0.001, ratio: float = 4.0, least: int = 4) -> DataFrame:
    """Significant lengths: (table_name, source, unit, width, bin, ended, at_risk, near_ended, near_at_risk, hazard, around, log_p).

    ``lengths`` has (table_name, source, unit, length). A length is significant if its Chernoff bound passes the
    Benjamini-Hochberg step within its table and source, its hazard is ``ratio`` times that of its neighbours and
    ``least`` texts end there. Lengths at which no text ends count among the neighbours with the texts that get there. Windows run
    over a row per distinct length and its neighbours, never over texts.
    """
    per = lengths.groupBy("table_name", "source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    bins = per.withColumn("width", F.explode(F.array(*[F.lit(w) for w in WIDTHS]))).groupBy("table_name", "source", "unit", "width", F.floor(F.col("length") / F.col("width")).alias("bin")).agg(F.sum("n").alias("ended"))
    by = Window.partitionBy("table_name", "source", "unit", "width").orderBy("bin")
    # of a gap only the bins near its ends are made, each once; beyond the last bin no text is at risk
    last, following = F.lag("bin").over(by), F.lead("bin").over(by)
    bins = bins.withColumn("lo", F.greatest(F.coalesce(last + _NEIGHBOURS + 1, F.floor(1 / F.col("width"))), F.col("bin") - _NEIGHBOURS))
    bins = bins.withColumn("hi", F.least(F.coalesce(following - 1, F.col("bin")), F.col("bin") + _NEIGHBOURS))
    at = F.explode(F.sequence(F.least("lo", "bin"), F.col("hi")))
    bins = bins.withColumn("at", at).withColumn("ended", F.when(F.col("at") == F.col("bin"), F.col("ended")).otherwise(0)).drop("bin", "lo", "hi").withColumnRenamed("at", "bin")
    at_risk = F.sum("ended").over(by.rowsBetween(0, Window.unboundedFollowing))
    near = [by.rangeBetween(-_NEIGHBOURS, -2), by.rangeBetween(2, _NEIGHBOURS)]
    both = lambda c: sum(F.coalesce(F.sum(c).over(w), F.lit(0)) for w in near)
    h = bins.withColumn("at_risk", at_risk)
    h = h.withColumns({"near_ended": both("ended").cast("bigint"), "near_at_risk": both("at_risk").cast("bigint")})
    h = h.withColumn("around", (F.col("near_ended") + 0.5) / (F.col("near_at_risk") + 1.0)).withColumn("hazard", F.col("ended") / F.col("at_risk"))
    h = h.withColumn("around", F.least(F.col("around"), F.lit(0.999)))
    q, p = F.least(F.col("hazard"), F.lit(1 - 1e-12)), F.col("around")
    divergence = q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p))
    h = h.withColumn("log_p", F.when(F.col("hazard") > p, -F.col("at_risk") * divergence).otherwise(0.0))
    h = h.where(F.col("ended") > 0)
    family = Window.partitionBy("table_name", "source")
    h = h.withColumn("k", F.row_number().over(family.orderBy("log_p", "unit", "width", "bin"))).withColumn("m", F.count(F.lit(1)).over(family))
    passed = F.max(F.when(F.col("log_p") <= F.log(F.lit(false_discovery) * F.col("k") / F.col("m")), F.col("k"))).over(family)
    h = h.withColumn("passed", F.coalesce(passed, F.lit(0)))
    return h.where((F.col("k") <= F.col("passed")) & (F.col("hazard") >= ratio * F.col("around")) & (F.col("ended") >= least)).drop("k", "m", "passed")


# --- endings -----------------------------------------------------------------------------------------------------


def _shaped(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which code points to keep so that runs of up to three digits become one."""
    digit = (kinds & 2) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], digit.view(np.int8), [0]])))
    short = np.zeros(len(points), bool)
    for size in (2, 3):
        at = edges[::2][edges[1::2] - edges[::2] == size]
        for j in range(1, size):
            short[at + j] = True
    return ~short


class _Words:
    """Words of a batch of texts, what follows each, and hashes of their contexts."""

    def __init__(self, text: pa.Array):
        points, offsets = code_points(text)
        kinds = classes(points)
        keep = _shaped(points, kinds)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        points, kinds = lowered(points[keep]), kinds[keep]
        points = np.where((kinds & 2) > 0, np.uint32(48), points)
        n = len(points)
        self.points, self.offsets = points, offsets
        word = (kinds & 3) > 0
        if n > 2:
            link = is_in(points, ".-'’/:_@#")
            for _ in range(3):  # up to three signs within a word, as in ://
                word[1:-1] |= link[1:-1] & word[:-2] & (word[2:] | link[2:])
            word &= ~(link & ~np.append(word[1:], False))
            word &= ~(link & ~np.append(word[1:], False))
        lone = (kinds & 8) > 0
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        first = word.copy()
        if n:
            first[1:] &= ~word[:-1] | lone[1:] | lone[:-1] | (row[1:] != row[:-1])
        self.starts = np.flatnonzero(first)
        self.word_at = np.cumsum(first) - 1
        last = word.copy()
        if n:
            last[:-1] &= ~word[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.row = row[self.starts] if n else self.starts
        self.word_chars = word
        mark = np.concatenate([[0], np.cumsum(is_in(points, CLOSING + "\n"))])
        upto = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.final = np.append(self.row[1:] != self.row[:-1], True) if len(self.row) else np.zeros(0, bool)
        upto = np.where(self.final, offsets[self.row + 1], upto) if len(self.row) else upto
        self.ended = mark[upto] > mark[self.ends] if len(self.row) else np.zeros(0, bool)
        # the hash of each word, of the word before and of that before it
        self.sums = prefix_sums(points)
        self.own = span_hashes(points, self.starts, self.ends, self.sums)
        self.before = [mixed(self._back(k) + np.uint64(k)) for k in (1, 2)]

    def _back(self, k: int) -> np.ndarray:
        out = np.full(len(self.own), k, np.uint64)
        if len(self.own) > k:
            out[k:] = np.where(self.row[k:] == self.row[:-k], self.own[:-k], np.uint64(k))
        return out

    def pair(self, at: np.ndarray) -> np.ndarray:
        """Hash of the words ``at`` with the word before each."""
        return mixed(self.own[at] * np.uint64(3) + self.before[0][at])

    def triple(self, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Hash of the words ``at`` with the two words before each."""
        return mixed(pair * np.uint64(5) + self.before[1][at])

    def begun(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a beginning ``h`` of the words ``at``, with the word before and with the two before."""
        two = mixed(h * np.uint64(7) + self.before[0][at])
        return two, mixed(two * np.uint64(13) + self.before[1][at])

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word) of every proper beginning of every word."""
        inside = np.flatnonzero(self.word_chars)
        at = self.word_at[inside]
        proper = inside + 1 < self.ends[at]
        inside, at = inside[proper], at[proper]
        return span_hashes(self.points, self.starts[at], inside + 1, self.sums), at


_ENDING = "table_name string, record_id bigint, source string, chars bigint, bytes bigint, body_chars bigint, marker string, closed boolean, dangling boolean, single bigint, pair bigint, triple bigint, begun_pair bigint, begun_triple bigint"


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, 2 * _ROWS) for whole in batches for at in range(0, whole.num_rows, 2 * _ROWS)):
        tails = b.column("tail")
        points, offsets = code_points(tails)
        w = _Words(tails)
        n = b.num_rows
        finals = np.flatnonzero(w.final)
        hashes = np.zeros((5, n), np.uint64)
        rows = w.row[finals]
        pair = w.pair(finals)
        for i, h in enumerate((w.own[finals], pair, w.triple(finals, pair), *w.begun(w.own[finals], finals))):
            hashes[i, rows] = h
        # what follows the last word: a mark that closes, one that leaves open, or nothing
        closed, dangling = np.zeros(n, bool), np.zeros(n, bool)
        kinds = classes(points)
        wordlike = (kinds & 3) > 0
        shut = is_in(points, CLOSING)
        open_ = is_in(points, ",;:-–—(«“「（、，；：&+=<\"'")
        closer = is_in(points, CLOSERS)
        torn = points == 0xFFFD  # half a character
        other = ~wordlike & ~shut & ~open_ & ~closer & ~torn & ((kinds & 4) == 0)
        index = np.arange(len(points))
        row_of = np.repeat(np.arange(n), np.diff(offsets))
        last_word = np.full(n, -1)
        last_word[row_of[wordlike]] = index[wordlike]  # of several the last stays
        behind = index > last_word[row_of]
        closed[row_of[behind & (shut | other)]] = True
        dangling[row_of[behind & open_]] = True
        dangling &= ~closed
        closed |= ~b.column("has_letter").to_numpy(zero_copy_only=False)  # numbers alone are no sentence that could break off
        torn = np.bincount(row_of[behind & torn], minlength=n) > 0
        closed &= ~torn
        dangling = (dangling & ~closed) | torn
        keep = {c: b.column(c) for c in ("table_name", "record_id", "source", "chars", "bytes", "body_chars", "marker")}
        yield pa.RecordBatch.from_pydict(keep | {"closed": closed, "dangling": dangling} | {c: hashes[i].view(np.int64) for i, c in enumerate(("single", "pair", "triple", "begun_pair", "begun_triple"))})


def endings(texts: DataFrame, tail: int = 200) -> DataFrame:
    """One row per text with its lengths and the hashes of its last words, of any length.

    Four words within the last ``tail`` characters, each after white space, are all that the last three can depend on; where they
    aren't there the task gets the whole text. Whether there is a letter is asked of the whole text.
    """
    last = F.right("body", F.lit(tail))
    enough = F.regexp_count(last, F.lit(r"\s\S*[\p{L}\p{N}]")) >= 4
    part = texts.select(
        "table_name", "record_id", "source", F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"), F.length("body").cast("bigint").alias("body_chars"), "marker",
        F.when(enough, last).otherwise(F.col("body")).alias("tail"), F.col("body").rlike(LETTER).alias("has_letter"),
    )
    return part.mapInArrow(_endings, _ENDING)


def _bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each hash; ``bits`` bounds what the driver gets and the tasks receive. A wrong hit costs a shuffled row, no result."""
    bit = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 29)]))
    words = hashes.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _is_held(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bloom) * 64 - 1)

    def probe(h: np.ndarray, shift: int) -> np.ndarray:
        at = (h >> np.uint64(shift)) & mask
        return (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    held = probe(h, 0)
    hit = np.flatnonzero(held)
    held[hit] = probe(h[hit], 29)
    return held


def _counter(every: np.ndarray, mine: np.ndarray, block: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the contexts of one block of hashes; ``every`` is the filter of all blocks, which only saves work, ``mine`` that of this one."""

    def wanted(h: np.ndarray) -> np.ndarray:
        return _is_held(every, h)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                w = _Words(whole.column("body").slice(at, _ROWS))
                kind = np.where(w.ended, 0, np.where(w.final, 2, 1))
                # a longer context is only asked for if its shorter ones are
                one = np.flatnonzero(wanted(w.own))
                two = w.pair(one)
                hit = wanted(two)
                three = w.triple(one[hit], two[hit])
                hit3 = wanted(three)
                start, word = w.beginnings()
                begun = wanted(start)
                start, word = start[begun], word[begun]
                begun2, begun3 = w.begun(start, word)
                begun3 = begun3[wanted(begun2)]
                begun2 = begun2[wanted(begun2)]
                begun3 = begun3[wanted(begun3)]
                hashes = [w.own[one], two[hit], three[hit3], begun2, begun3]
                kinds = [kind[one], kind[one[hit]], kind[one[hit][hit3]], np.ones(len(begun2), np.int64), np.ones(len(begun3), np.int64)]
                key, kind = np.concatenate(hashes), np.concatenate(kinds)
                if blocks > 1:
                    here = (key >> np.uint64(40)) % np.uint64(blocks) == block
                    here[here] = _is_held(mine, key[here])
                    key, kind = key[here], kind[here]
                distinct, inverse = np.unique(key, return_inverse=True)
                out = [np.bincount(inverse[kind == j], minlength=len(distinct)) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *[pa.array(x.astype(np.int64)) for x in out]], names=["h", "ended", "went_on", "open"])

    return count


def context_counts(texts: DataFrame, looked_up: DataFrame, block_bits: int = _BLOCK_BITS) -> DataFrame:
    """(h, ended, went_on, open) of the contexts in ``looked_up`` (column h, distinct, a written table) over all texts, whole.

    A sentence ended after the words, went on (or the last word did), or the text stopped without a mark. The contexts are counted in blocks
    whose filter has ``block_bits`` at most, so wrong hits stay a small part of the shuffle however many contexts are asked
    for; each block is a pass over the texts. The driver holds the filter of one block and that of all, which is no larger.
    """
    n = looked_up.count()
    bits = lambda m: min(block_bits, 1 << max(16, (_BITS_EACH * m - 1).bit_length()))
    blocks = max(1, -(-_BITS_EACH * n // block_bits))
    every, schema, parts = _bloom(looked_up, bits(n)), "h bigint, ended bigint, went_on bigint, open bigint", []
    for b in range(blocks):
        mine = every if blocks == 1 else _bloom(looked_up.where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(blocks)) == b), block_bits)
        counted = texts.select("body").mapInArrow(_counter(every, mine, b, blocks), schema)
        parts.append(written(counted.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("ended", "went_on", "open")]), "contexts"))
    return reduce(DataFrame.unionByName, parts)


_KINDS = ("single", "pair", "triple", "begun_pair", "begun_triple")


def judged(rows: DataFrame, texts: DataFrame, block_bits: int = _BLOCK_BITS) -> DataFrame:
    """``endings`` rows with ``finished`` (0 to 1: how often such an ending finishes; null if the corpus doesn't know it or needn't be asked) and ``seen`` (how often it occurs elsewhere).

    Only endings that stop after a word, neither closed nor at an open mark, depend on the corpus.
    """
    contexts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("h")) for k in _KINDS])).alias("c")
    asked = rows.where(~F.col("closed") & ~F.col("dangling")).select("table_name", "record_id", contexts).select("table_name", "record_id", "c.kind", "c.h")
    counts = context_counts(texts, written(asked.select("h").distinct(), "asked"), block_bits)
    found = asked.join(counts, "h").groupBy("table_name", "record_id").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in _KINDS for c in ("ended", "went_on", "open")])
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")

    def finished(k: str) -> tuple[Column, Column]:
        # the text itself is one of the open ones; where the word mostly goes on elsewhere, open ends may all be cuts
        longer = z(f"begun_{'pair' if k == 'single' else k}_went_on")
        opened = F.when(longer <= z(f"{k}_open"), F.greatest(z(f"{k}_open") - 1, F.lit(0.0))).otherwise(0.0)
        done, on = z(f"{k}_ended") + opened, z(f"{k}_went_on") + (longer if k != "single" else F.lit(0.0))
        return done / F.greatest(done + on, F.lit(1.0)), done + on

    share, seen = F.lit(None).cast("double"), F.lit(0.0)
    for k in ("single", "pair", "triple"):
        s, n = finished(k)
        least = 5 if k == "single" else 3
        share, seen = F.when(n >= least, s).otherwise(share), F.when(n >= least, n).otherwise(seen)
    return rows.join(found.select("table_name", "record_id", share.alias("finished"), seen.alias("seen")), ["table_name", "record_id"], "left")


# --- cuts --------------------------------------------------------------------------------------------------------


def _in_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with ``at_limit`` (the width of the narrowest significant length they have, else null).

    The lengths of the significant bins are few, so the rows needn't be shuffled to meet them.
    """
    lengths = limits.select("table_name", "source", "unit", "width", F.explode(F.sequence(F.col("bin") * F.col("width"), (F.col("bin") + 1) * F.col("width") - 1)).alias("length"))
    narrowest = lengths.groupBy("table_name", "source", "unit", "length").agg(F.min("width").alias("w"))
    for u in _UNITS:
        rows = rows.join(narrowest.where(F.col("unit") == u).select("table_name", "source", F.col("length").alias(u), F.col("w").alias(f"_{u}")), ["table_name", "source", u], "left")
    return rows.withColumn("at_limit", F.least(*[F.col(f"_{u}") for u in _UNITS])).drop(*[f"_{u}" for u in _UNITS])


def limits_of(rows: DataFrame, **how) -> DataFrame:
    """Significant lengths of ``endings`` rows, in characters and bytes of the text and characters without its marker."""
    lengths = rows.select("table_name", "source", F.explode(F.create_map(*[x for u in _UNITS for x in (F.lit(u), F.col(u))])).alias("unit", "length"))
    return length_hazards(lengths, **how)


def truncated(texts: DataFrame, broken_below: float = 0.02, least_seen: int = 4, finished_from: float = 0.95, block_bits: int = _BLOCK_BITS) -> DataFrame:
    """Every non-empty text of ``prepared`` rows with ``cut`` (boolean), ``by`` (limit or mid-transfer, else null) and the evidence for it.

    Columns: table_name, record_id, source, chars, bytes, body_chars, marker, closed, dangling, finished, seen, at_limit, broken, cut, by.
    ``record_id`` must be a bigint, unique within its table; repeated texts are judged each. ``at_limit`` is the width of the significant length that
    the text has, ``broken`` an ending that the corpus never finishes. Null and empty texts have no row; an empty
    table gives none.
    """
    rows = written(endings(texts), "endings")
    rows = judged(_in_limits(rows, written(limits_of(rows), "limits")), texts, block_bits)
    known = F.coalesce(F.col("finished"), F.lit(0.5))
    at, exact, band = F.col("at_limit").isNotNull(), F.coalesce(F.col("at_limit") == 1, F.lit(False)), F.coalesce(F.col("at_limit") > 1, F.lit(False))
    unfinished = ~F.col("closed") & (known < finished_from)
    marked = F.col("marker") != ""
    at_length = (exact & unfinished) | (at & marked & (unfinished | F.col("marker").startswith("["))) | (band & ~F.col("closed") & (known < 0.1))
    broken = ~F.col("closed") & (F.col("dangling") | F.coalesce((F.col("finished") <= broken_below) & (F.col("seen") >= least_seen), F.lit(False)))
    by = F.when(at_length | (at & broken), "limit").when(broken, "mid-transfer")
    columns = ["table_name", "record_id", "source", "chars", "bytes", "body_chars", "marker", "closed", "dangling", "finished", "seen", "at_limit", "broken", "cut", "by"]
    return rows.withColumns({"broken": broken, "by": by, "cut": at_length | broken}).select(*columns)


def rates(judged_rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """(table_name, source, records, cut, at_limit, mid_transfer, share) over all records of ``all_rows`` (table_name, source), those without a text included."""
    n = lambda c, name: F.count_if(c).alias(name)
    cuts = judged_rows.where("cut").groupBy("table_name", "source").agg(F.count(F.lit(1)).alias("cut"), n(F.col("by") == "limit", "at_limit"), n(F.col("by") == "mid-transfer", "mid_transfer"))
    every = all_rows.groupBy("table_name", F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("records"))
    z = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("cut", "at_limit", "mid_transfer")}
    return every.join(cuts, ["table_name", "source"], "left").withColumns(z).withColumn("share", F.col("cut") / F.col("records"))
