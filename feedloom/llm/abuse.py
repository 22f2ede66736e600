"""Scores for abusive, hateful and sexual content: cumulative-link ordinal regression on sparse text features.

Severity grades come from human verdicts: 0 where all raters found a document clean, 1 where they disagree, 2 where
all flagged it. A grade is caused by single sentences, so a sentence is scored by one weight per
feature, shared by all thresholds, and a document by its worst sentence: P(grade >= k) = sigmoid(score - threshold_k).

1. The vocabulary are the features of a bounded sample of documents that raters flagged. Spark counts over all documents in how many each
   feature occurs, and in how many flagged and clean ones. A mixture of two kinds of features, bound to abuse or to anything else, gives
   each the log odds of being bound to abuse: far more of its documents are flagged than of others.
2. Sentences with such a feature are candidates. Spark finds them, with all their features, in a bounded sample of documents with and without
   verdicts; the regression is fitted on them, starting from the log odds. Which sentence made raters flag a document is not known:
   each has the belief that models without its document give it, against the chance that the verdict errs.
3. Every document is scored by its candidates; the cutoff comes from the severities of all documents, each by a model that hasn't seen it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.language import segments
from feedloom.llm.textarrays import classes, code_points, is_in, lowered, mixed, span_hashes
from feedloom.session import written

#: Signs that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}


#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("асеіјорѕухԁһкмнтвαοερν", "aceijopsyxdhkmhtbaoepv", strict=True))


#: Bins of severity of which a cutoff is chosen, and folds of documents by their hashed ids.
_BINS, _FOLDS = 4096, 10
#: Texts whose features are made at once, and the score of a text without a candidate.
_AT_ONCE, _NONE = 500, -30.0
_TABLE_BITS = 22


def _undisguised(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, word mask and segment starts, with signs within words as the letters they stand for, look-alikes as Latin letters, drawn-out letters shortened and single spaced letters joined."""
    kinds = classes(points)
    keep = (kinds & 16) == 0
    seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))[keep]
    points, kinds = lowered(points[keep]), kinds[keep]
    foreign = is_in(points, "".join(LOOKALIKES))
    if foreign.any():
        points = points.copy()
        for a, b in LOOKALIKES.items():
            points[foreign & (points == ord(a))] = ord(b)
    letter = (kinds & 1) > 0
    again = np.append(False, points[1:] == points[:-1]) & letter & ((kinds & 8) == 0)
    third = again & np.append(False, again[:-1])
    if third.any():  # three of the same letter and more are one
        first = np.flatnonzero(third) - 2
        drop = third.copy()
        drop[first + 1] = True
        points, kinds, letter, seg = points[~drop], kinds[~drop], letter[~drop], seg[~drop]
    sign = is_in(points, "".join(DISGUISES) + "*#")
    near = np.zeros(len(points), bool)
    for _ in range(4):  # signs next to letters, and next to such signs
        near |= sign & (np.append(False, (letter | near)[:-1]) | np.append((letter | near)[1:], False))
    digit_run = (kinds & 2) > 0
    # a sign counts within a word only if letters stand on both sides of its run
    left = np.append(False, (letter | near)[:-1])
    right = np.append((letter | near)[1:], False)
    inside = near & left & right
    out = points.copy()
    for a, b in DISGUISES.items():
        out[inside & (points == ord(a))] = ord(b)
    out[inside & is_in(points, "*#")] = ord("*")
    word = letter | inside
    digits = digit_run & ~inside
    out[digits] = 48
    digits &= ~np.append(False, digits[:-1])  # a number is one sign
    word |= digits
    gap = ~word
    if len(points) > 4:
        # letter, gap, letter: drop the gap where both letters stand alone
        lone = letter & ((kinds & 8) == 0) & np.append(True, gap[:-1]) & np.append(gap[1:], True)
        single = np.zeros(len(points), bool)
        single[1:-1] = gap[1:-1] & lone[:-2] & lone[2:] & (points[1:-1] != 10)
        run = single.copy()  # two gaps in a row at least, so three letters
        run[2:] &= single[:-2]
        run[:-2] |= run[2:]
        drop = single & (run | np.append(run[2:], [False, False]))
        out, word, seg = out[~drop], word[~drop], seg[~drop]
    drop = np.append(False, (out[1:] == 48) & (out[:-1] == 48)) & ~word
    out, word, seg = out[~drop], word[~drop], seg[~drop]
    return out, word, np.searchsorted(seg, np.arange(len(starts)))


def features(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, 64-bit hash) of the features in a segment, with repeats: words, word pairs and triples, and four letters in a row."""
    points, word, starts = _undisguised(points, starts)
    n = len(points)
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    lone = (classes(points) & 8) > 0
    first, last = word.copy(), word.copy()
    edge = lone[1:] | lone[:-1] | (seg[1:] != seg[:-1])
    first[1:] &= ~word[:-1] | edge
    last[:-1] &= ~word[1:] | edge
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    own, where = span_hashes(points, a, b), seg[a]
    out, longer = [(where, own)], own
    with np.errstate(over="ignore"):
        for k in (1, 2):  # a pair, then the triple that begins with it
            if len(own) > k:
                longer = mixed(longer[: len(own) - k] * np.uint64(3) + own[k:] * np.uint64(k))
                same = where[k:] == where[:-k]
                out.append((where[:-k][same], longer[same]))
        # four code points in a row within a word, a word end counting as one
        code = np.where(word, points, 0).astype(np.uint64)
        if n >= 4:
            four = mixed(code[:-3] * np.uint64(0x9E3779B97F4A7C15) + code[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:-1] * np.uint64(0x165667B19E3779F9) + code[3:] * np.uint64(0x27D4EB2F165667C5))
            ok = word[1:-2] & word[2:-1] & (seg[:-3] == seg[3:])
            out.append((seg[1:-2][ok], four[ok]))
    return np.concatenate([s for s, _ in out]).astype(np.int64), np.concatenate([h for _, h in out])


class _Vocabulary:
    """Sorted 64-bit hashes, with a table of their low bits that rules most other hashes out."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "_table": None}

    def among(self, groups: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, place in the vocabulary) of the known hashes, sorted, each once in a group."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mask = np.uint64((1 << _TABLE_BITS) - 1)
        if self._table is None:
            self._table = np.zeros(1 << _TABLE_BITS, bool)
            self._table[(self.hashes & mask).astype(np.int64)] = True
        maybe = np.flatnonzero(self._table[(h & mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        key = np.sort((groups[maybe[hit]] << 32) | at[hit])
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        return key >> 32, key & 0xFFFFFFFF


@dataclass
class OrdinalModel:
    """What tells candidates and scores them; row k of the arrays is the model without the documents of fold k, the last row that of all.

    ``bound``: by feature of ``vocabulary`` its log odds of being bound to abuse, 0 if below even; ``weights``: the fitted weights; ``thresholds``
    increase; ``cutoff``: the expected severity from which a document counts as a case.
    """

    vocabulary: _Vocabulary
    bound: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = 1.0

    @property
    def fitted(self) -> bool:
        return len(self.vocabulary.hashes) > 0


def _nothing(levels: int) -> OrdinalModel:
    return OrdinalModel(_Vocabulary(np.zeros(0, np.uint64)), np.zeros((_FOLDS + 1, 0), np.float32), np.zeros((_FOLDS + 1, 0), np.float32), np.full((_FOLDS + 1, levels - 1), 31.0), float(levels))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bound_odds(documents: np.ndarray, flagged: np.ndarray, clean: np.ndarray, total: int, total_flagged: int, total_clean: int, most: float = 4.0) -> np.ndarray:
    """Log odds, from 0 to ``most``, that a feature is bound to abuse, from the numbers of documents that hold it.

    Of the documents of other features as many are flagged as of all; of those of bound ones a share that is estimated together with the
    number of such features by expectation and maximisation. Features of one document teach nothing about others and get 0.
    """
    ok = documents >= 2
    if not ok.any() or not total_flagged:
        return np.zeros(len(documents), np.float32)
    base, base_clean = total_flagged / total, max(total_clean, 0.5) / total
    rate, rate_clean, share = min(0.9, 30 * base), 0.02, 0.05
    rest = documents - flagged - clean
    odds = np.zeros(len(documents))
    for _ in range(30):
        other = np.log(max(1 - rate - rate_clean, 0.01) / max(1 - base - base_clean, 0.01))
        odds = flagged * np.log(rate / base) + clean * np.log(rate_clean / base_clean) + rest * other + np.log(share / (1 - share))
        p = _sigmoid(odds[ok])
        n = (p * documents[ok]).sum() + 1e-9
        share = np.clip(p.mean(), 1e-4, 0.5)
        rate, rate_clean = np.clip((p * flagged[ok]).sum() / n, min(0.9, 2 * base), 0.95), np.clip((p * clean[ok]).sum() / n, 0.003, 0.2)
    return np.where(ok, np.clip(odds, 0, most), 0).astype(np.float32)


def _batched(run: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``run`` with a few rows at a time and their code points, sentence starts, the rows of the sentences, and the features (segment, hash)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _AT_ONCE):
                b = whole.slice(i, _AT_ONCE)
                points, offsets = code_points(b.column("_text"))
                starts, row = segments(points, offsets)
                seg, h = features(points, starts) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                yield from run(b, offsets, starts, row, seg, h)

    return over


def _distinct_features(texts: DataFrame) -> np.ndarray:
    """The sorted hashes of all features of a bounded number of texts."""
    run = _batched(lambda b, offsets, starts, row, seg, h: iter([pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["h"])]))
    found = texts.select("_text").mapInArrow(run, "h bigint").distinct().toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def _document_counts(texts: DataFrame, vocabulary: _Vocabulary, fold: bool) -> np.ndarray:
    """In how many texts each feature occurs, by fold (column _fold) if asked: one row per feature and task goes into the sum."""
    folds = _FOLDS if fold else 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((folds, len(vocabulary.hashes)), np.int64)

        def add(b: pa.RecordBatch, offsets: np.ndarray, starts: np.ndarray, row: np.ndarray, seg: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            doc, at = vocabulary.among(row[seg], h)
            np.add.at(n, (b.column("_fold").to_numpy()[doc] if fold else np.zeros(len(doc), np.int64), at), 1)
            return iter(())

        for _ in _batched(add)(batches):
            pass
        f, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[f, at])], names=["f", "at", "n"])

    got = texts.select("_text", *(["_fold"] if fold else [])).mapInArrow(count, "f int, at int, n bigint").groupBy("f", "at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((folds, len(vocabulary.hashes)), np.int64)
    out[got.column("f").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


_CANDIDATE = "doc bigint, fold int, grade int, size int, features array<bigint>"


def _candidates(texts: DataFrame, positive: _Vocabulary) -> DataFrame:
    """``_CANDIDATE`` rows: the sentences of (_id, _fold, grade, _text) rows that hold a feature of ``positive``, with all their features."""

    def find(b: pa.RecordBatch, offsets: np.ndarray, starts: np.ndarray, row: np.ndarray, seg: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        chosen = np.flatnonzero(np.bincount(positive.among(seg, h)[0], minlength=len(starts)))
        number = np.full(len(starts), -1)
        number[chosen] = np.arange(len(chosen))
        mine = number[seg] >= 0
        s, f = number[seg[mine]], h[mine]
        order = np.lexsort((f, s))
        s, f = s[order], f[order]
        new = np.append(True, (s[1:] != s[:-1]) | (f[1:] != f[:-1])) if len(s) else np.zeros(0, bool)
        s, f = s[new], f[new]
        bounds = np.append(np.searchsorted(s, np.arange(len(chosen))), len(s)).astype(np.int32)
        doc = row[chosen]
        size = np.bincount(seg, minlength=len(starts))[chosen].astype(np.int32)
        take = lambda c: b.column(c).take(pa.array(doc))
        yield pa.RecordBatch.from_arrays([take("_id"), take("_fold"), take("grade"), pa.array(size), pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.view(np.int64)))], names=["doc", "fold", "grade", "size", "features"])

    return texts.select("_id", "_fold", "grade", "_text").mapInArrow(_batched(find), _CANDIDATE)


@dataclass
class _Sentences:
    """Candidates as flat arrays: (seg, feature) pairs, and document, fold, grade and 1 / sqrt(number of features) of each."""

    seg: np.ndarray
    feature: np.ndarray
    doc: np.ndarray
    fold: np.ndarray
    grade: np.ndarray
    value: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.seg, w[self.feature], minlength=len(self.doc)) * self.value


def _fit_ordinal(x: _Sentences, start: np.ndarray, train: np.ndarray, belief: np.ndarray, weight: np.ndarray, levels: int, penalty: float, steps: int, first: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient descent with per-weight step sizes on the cumulative-link likelihood of the ``train`` sentences.

    A sentence has its grade with probability ``belief``, else grade 0. Weights begin at ``start`` and are drawn back to it.
    """
    w, t = start.astype(np.float64), first + np.arange(levels - 1) / 2
    sq, sqt = np.full(len(w), 1e-8), np.full(levels - 1, 1e-8)
    passed = (x.grade[:, None] > np.arange(levels - 1)[None, :]) * belief[:, None]
    weight = np.where(train, weight, 0.0)
    total = max(weight.sum(), 1e-9)
    for _ in range(steps):
        # one logistic term per threshold, its weights shared
        error = (_sigmoid(x.scores(w)[:, None] - t[None, :]) - passed) * weight[:, None] / total
        g = np.bincount(x.feature, (error.sum(1) * x.value)[x.seg], minlength=len(w)) + penalty * (w - start)
        gt = -error.sum(0)
        sq += g * g
        sqt += gt * gt
        w -= 0.3 * g / np.sqrt(sq)
        t = np.maximum.accumulate(t - 0.3 * gt / np.sqrt(sqt))
    return w, t


def fit(x: _Sentences, start: np.ndarray, levels: int = 3, rounds: int = 2, penalty: float = 1e-4, wrong: float = 0.5, trust: float = 0.2, steps: int = 30, first: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the models without each fold and, last, of that of all, from ``start`` weights by model.

    Each sentence of a flagged document gets the belief that the model without its document gives it among the document's candidates, against
    the chance ``wrong`` that the verdict errs; regression and belief alternate. Documents without a verdict (grade -1) count as clean with weight
    ``trust``; beliefs, rare as they are, weigh more.
    """
    flagged, docs = x.grade > 0, int(x.doc.max(initial=-1)) + 1
    own = np.zeros(len(x.doc))
    for f in range(_FOLDS):
        own = np.where(x.fold == f, x.scores(start[f]) - first, own)
    w, t = np.zeros(start.shape), np.zeros((len(start), levels - 1))
    for _ in range(rounds):
        odds = np.exp(np.clip(own, -20, 20))
        belief = np.where(flagged, odds / (np.bincount(x.doc, odds, minlength=docs) + wrong)[x.doc], 0.0)
        weight = np.where(x.grade < 0, trust, 1.0) * (1.0 + 4.0 * belief)
        for f in range(_FOLDS + 1):
            w[f], t[f] = _fit_ordinal(x, start[f], x.fold != f, belief, weight, levels, penalty, steps, first)
            own = np.where(x.fold == f, x.scores(w[f]) - t[f, 0], own)
    return w, t


def severity_bin(severity: np.ndarray, levels: int) -> np.ndarray:
    """The bin from 0 to ``_BINS`` - 1 of severities from 0 to ``levels`` - 1, by their logarithm, so that low ones are told apart as well."""
    return np.clip(((np.log(np.maximum(severity, 1e-14) / (levels - 1)) / 32 + 1) * _BINS).astype(np.int64), 0, _BINS - 1)


def bin_severity(at: int, levels: int) -> float:
    """The lowest severity of a bin."""
    return float((levels - 1) * np.exp((at / _BINS - 1) * 32)) if at else 0.0


def best_cutoff(documents: np.ndarray, flagged: np.ndarray, clean: np.ndarray) -> int:
    """The bin of the best balance of cases found and right hits, from the numbers of documents and of documents that raters flagged and found clean by ``severity_bin``.

    Severities must come from models that haven't seen the document. Raters saw more flagged documents than there are elsewhere, so
    ``documents`` tell how many a cutoff flags and ``flagged`` only which part of the cases it finds. The share of all documents that are cases is
    that of the hits over that of the cases found, at the cutoff that finds three tenths of them, where hits are mostly right. Of the hits that
    raters saw they must have flagged as many as they found clean, else the labels are too few to tell; where no cutoff has that it lies above all. Any
    bin but the first, which holds the documents without any sign, may be the cutoff.
    """
    hit = np.cumsum(documents[::-1])[::-1] / max(1, documents.sum())
    recall = np.cumsum(flagged[::-1])[::-1] / max(1, flagged.sum())
    sure = max(1, int(np.flatnonzero(recall >= min(0.3, recall[1]))[-1]))
    prevalence = max(hit[sure], 1 / max(1, documents.sum())) / max(recall[sure], 1 / max(1, flagged.sum()))
    balance = np.where(np.cumsum((flagged - clean)[::-1])[::-1][1:] >= 0, recall[1:], 0) / (hit[1:] + prevalence)
    return int(np.flatnonzero(balance * 1.0001 >= balance.max())[-1] + 1) if balance.max() > 0 else _BINS


def graded(labels: DataFrame, doc_id: str = "doc_id", verdict: str = "verdict", flagged: str = "flagged", clean: str = "clean") -> DataFrame:
    """(doc_id, grade) of documents with a verdict: 0 all clean, 1 divided, 2 all flagged. Null and other verdicts don't count."""
    v = F.lower(F.btrim(F.col(verdict)))
    n = labels.where(v.isin(flagged, clean) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.count_if(v == flagged).alias("f"), F.count_if(v == clean).alias("c"))
    return n.select("doc_id", F.when(F.col("f") == 0, 0).when(F.col("c") > 0, 1).otherwise(2).alias("grade"))


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    h = F.xxhash64(F.col(doc_id))
    return documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"), h.alias("_id"), F.pmod(h, F.lit(_FOLDS)).cast("int").alias("_fold"))


def _part(share: float) -> Column:
    """Rows whose hashed id is in the lowest ``share`` of all: ids hash evenly, so that about this part of them."""
    return F.col("_id") <= min(2**63 - 1, int(min(1.0, share) * 2**64) - 2**63)


def fit_on(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 8_000, unlabelled: int = 20_000, levels: int = 3) -> OrdinalModel:
    """Fits on about ``sample`` documents with a verdict and ``unlabelled`` without one, chosen by hashed id; features are counted over all documents.

    The driver gets the vocabulary, a count per feature and the candidate sentences of the sample, never a text.
    """
    grades = graded(labels)
    texts = _texts(documents, doc_id, text)
    labelled = written(texts.join(grades, "doc_id"), "labelled")
    n = {r.grade: r["count"] for r in labelled.groupBy("grade").count().collect()}
    n_flagged, n_clean = n.get(1, 0) + n.get(2, 0), n.get(0, 0)
    if not n_flagged or not n_clean:
        return _nothing(levels)
    taken, total = labelled.where(_part(sample / (n_flagged + n_clean))), documents.count()
    hashes = _distinct_features(taken.where("grade > 0"))
    flagged, clean = (_document_counts(labelled.where(c), _Vocabulary(hashes), True) for c in ("grade > 0", "grade = 0"))
    # what more than twice as many clean documents hold as flagged ones isn't bound to abuse and needn't be counted elsewhere
    kept = clean.sum(0) <= 2 * flagged.sum(0)
    vocabulary, flagged, clean = _Vocabulary(hashes[kept]), flagged[:, kept], clean[:, kept]
    every = _document_counts(texts, vocabulary, False)[0]
    folds = labelled.groupBy("_fold").agg(F.count_if(F.col("grade") > 0).alias("f"), F.count_if(F.col("grade") == 0).alias("c")).collect()
    out = np.zeros((_FOLDS + 1, 2), np.int64)
    for r in folds:
        out[r["_fold"]] = r.f, r.c
    bound = np.stack(
        [
            bound_odds(every - (flagged[f] + clean[f] if f < _FOLDS else 0), flagged.sum(0) - (flagged[f] if f < _FOLDS else 0), clean.sum(0) - (clean[f] if f < _FOLDS else 0), total - out[f].sum(), n_flagged - out[f, 0], n_clean - out[f, 1])
            for f in range(_FOLDS + 1)
        ]
    )
    positive = bound.max(0) > 0
    others = texts.where(_part(unlabelled / max(1, total))).join(grades.select("doc_id"), "doc_id", "left_anti").withColumn("grade", F.lit(-1))
    columns = ["_id", "_fold", "grade", "_text"]
    got = _candidates(taken.select(*columns).unionByName(others.select(*columns)), _Vocabulary(vocabulary.hashes[positive])).toArrow().combine_chunks()
    if not got.num_rows:
        return _nothing(levels)
    lists = got.column("features").combine_chunks()
    seg, h = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy().view(np.uint64)
    known, feature, times = np.unique(h, return_inverse=True, return_counts=True)
    keep = (times >= 2)[feature]
    hashes, feature = known[times >= 2], (np.cumsum(times >= 2) - 1)[feature[keep]]
    place = np.minimum(np.searchsorted(vocabulary.hashes, hashes), len(vocabulary.hashes) - 1)
    start = np.where(vocabulary.hashes[place] == hashes, bound[:, place], 0).astype(np.float32)
    _, doc = np.unique(got.column("doc").to_numpy(), return_inverse=True)
    column = lambda c: got.column(c).to_numpy()
    x = _Sentences(seg[keep], feature, doc, column("fold"), column("grade"), 1 / np.sqrt(np.maximum(column("size"), 1)))
    weights, thresholds = fit(x, start, levels)
    # features that no candidate of the sample has twice keep their odds as weight
    every_hash = np.union1d(hashes, vocabulary.hashes[positive])
    both, odds = np.zeros((_FOLDS + 1, len(every_hash)), np.float32), np.zeros((_FOLDS + 1, len(every_hash)), np.float32)
    odds[:, np.searchsorted(every_hash, vocabulary.hashes[positive])] = bound[:, positive]
    both[:] = odds
    both[:, np.searchsorted(every_hash, hashes)] = weights
    return OrdinalModel(_Vocabulary(every_hash), odds, both, thresholds)


_SCORED = "severity double, p_divided double, p_severe double, flagged boolean, worst_start int, worst_length int"


def score_rows(model: OrdinalModel, fold: np.ndarray, offsets: np.ndarray, starts: np.ndarray, row: np.ndarray, seg: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """``_SCORED`` and ``unseen``, the severity by the model that hasn't seen the text's fold, by column; a text without a candidate has severity 0 and no worst sentence (-1, 0)."""
    n, levels = len(fold), model.thresholds.shape[1] + 1
    s, feature = model.vocabulary.among(seg, h)
    value = 1 / np.sqrt(np.maximum(np.bincount(seg, minlength=len(starts)), 1))

    def worst(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, worst sentence or -1) of each text by the model ``which`` of each of its features."""
        candidate = np.bincount(s, model.bound[which, feature], minlength=len(starts)) > 0
        points = np.where(candidate, np.bincount(s, model.weights[which, feature], minlength=len(starts)) * value, _NONE)
        best, at = np.full(n, _NONE), np.full(n, -1)
        if len(starts):
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            best[row[begin]] = np.maximum.reduceat(points, begin)
            first = np.flatnonzero(candidate & (points == best[row]))[::-1]  # of equal ones the first stays
            at[row[first]] = first
        return best, at

    all_of = np.full(len(s), _FOLDS)
    top, at = worst(all_of)
    other, _ = worst(fold[row[s]])
    p = np.where(top[:, None] > _NONE, _sigmoid(top[:, None] - model.thresholds[-1][None, :]), 0.0)
    severity, some = p.sum(1), at >= 0
    length = np.append(starts[1:], offsets[-1]) - starts if len(starts) else starts
    where, size = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    where[some], size[some] = starts[at[some]] - offsets[:-1][some], length[at[some]]
    unseen = np.where(other > _NONE, _sigmoid(other[:, None] - model.thresholds[fold]).sum(1), 0.0)
    flagged = (severity >= model.cutoff) & some & (model.cutoff <= levels - 1)
    return {"severity": severity, "p_divided": p[:, 0], "p_severe": p[:, -1], "flagged": flagged, "worst_start": where, "worst_length": size, "unseen": unseen}


def _scorer(model: OrdinalModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(b: pa.RecordBatch, *parts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = score_rows(model, b.column("_fold").to_numpy(), *parts)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *map(pa.array, out.values())], names=["doc_id", "source", *out])

    return _batched(run)


def scored_by(model: OrdinalModel, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, severity, p_divided, p_severe, flagged, worst_start, worst_length, unseen) of every document by a fitted model."""
    kinds = dict(documents.dtypes)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(text, F.lit("")).alias("_text"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(_FOLDS)).cast("int").alias("_fold"))
    return rows.select("doc_id", "source", "_text", "_fold").mapInArrow(_scorer(model), f"doc_id {kinds[doc_id]}, source {kinds[source]}, {_SCORED}, unseen double")


def score(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", model: OrdinalModel | None = None) -> DataFrame:
    """(doc_id, source, severity, p_divided, p_severe, flagged, worst_start, worst_length) of every document.

    Texts are read whole; a null text counts as empty, with severity 0. Copies and repeated ids are scored each; other columns are
    ignored. Without labels of both kinds no document is flagged. The models sent to the tasks have a bounded size. Without a ``model``
    one is fitted, and ``corpus_cutoff`` takes its cutoff from all documents and all labels.
    """
    if model is not None:
        return scored_by(model, documents, doc_id, text, source).drop("unseen")
    model = fit_on(documents, labels, doc_id, text)
    if not model.fitted:
        return scored_by(model, documents, doc_id, text, source).drop("unseen")
    scored = written(scored_by(model, documents, doc_id, text, source), "scores")
    cutoff = corpus_cutoff(scored, labels, model.thresholds.shape[1] + 1)
    return scored.withColumn("flagged", (F.col("severity") >= cutoff) & (F.col("worst_start") >= 0)).drop("unseen")


def corpus_cutoff(scored: DataFrame, labels: DataFrame, levels: int) -> float:
    """The severity that ``best_cutoff`` gives for all rows of (doc_id, unseen) and all labels; the driver gets a row per bin.

    The models of the folds know nearly as much as that of all. A document without a verdict has about the same severity by both, so the cutoff lets
    as few wrong ones pass, while cases whose verdict the model of all knows lie higher.
    """
    log = F.log(F.greatest(F.col("unseen"), F.lit(1e-14)) / F.lit(float(levels - 1)))
    at = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), F.floor((log / 32 + 1) * _BINS))).alias("bin")
    by = scored.join(graded(labels), "doc_id", "left").groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") > 0).alias("f"), F.count_if(F.col("grade") == 0).alias("c"))
    documents, flagged, clean = np.zeros((3, _BINS), np.int64)
    for r in by.collect():
        documents[r.bin], flagged[r.bin], clean[r.bin] = r.n, r.f, r.c
    return bin_severity(best_cutoff(documents, flagged, clean), levels)


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_severity); rows without a source are one source, null."""
    by = scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg("severity").alias("mean_severity"))
    return by.withColumn("rate", F.col("flagged") / F.col("documents"))
