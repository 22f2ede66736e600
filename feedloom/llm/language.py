"""Language of records and of single foreign sentences by string-kernel classification.

The kernel of two sentences is the number of character n-grams (n = 1..3, the blended spectrum, presence only)
they share over the root of the product of their own numbers. It is approximated by Nyström landmarks,
and one-versus-rest kernel ridge regression is fitted on the landmark features. Since the kernel is linear in the
n-gram presences, landmark matrix and regression weights multiply out to one weight per n-gram and
language, so a batch of sentences is scored by one sparse matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.textarrays import classes, code_points, is_in, lowered

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt", "zh", "ja")
_BITS = 20


def segments(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows) of the sentences: they end at a newline, at a closing mark before white space, at one of Han script, and with the value."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = classes(points) & 4 > 0
    after = np.append(space[1:], True)
    mark = is_in(points, ".!?…。！？")
    end = (mark & after) | is_in(points, "。！？\n\r")
    closing = is_in(points, "\")]}'’”»」』）")
    shut = closing & np.append(False, mark[:-1])
    end = (end & ~np.append(closing[1:], False)) | (shut & (after | np.append(False, is_in(points, "。！？")[:-1])))
    first = np.zeros(n + 1, bool)
    first[1:] = end
    first[offsets] = True
    starts = np.flatnonzero(first[:n])
    return starts, np.searchsorted(offsets, starts, side="right") - 1


def _without_links(points: np.ndarray, letter: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Letters, but those of tokens that hold ``@``, ``://`` or a dot between letters, as addresses do; a token starts at each ``border``."""
    mark = points == 64
    mark[1:-1] |= ((points[:-2] == 58) & (points[1:-1] == 47) & (points[2:] == 47)) | ((points[1:-1] == 46) & letter[:-2] & letter[2:])
    if not mark.any():
        return letter
    token = np.cumsum(border)
    bad = np.zeros(token[-1] + 1, bool)
    bad[token[mark]] = True
    return letter & ~bad[token]


def gram_presences(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, n-gram) of each n-gram present in a segment, sorted; letters per segment. n-grams lie within words, with word ends marked."""
    kinds = classes(points)
    letter = _without_links(points, (kinds & 1) > 0, (kinds & 12) > 0)
    segment_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    letters = np.bincount(segment_of[letter], minlength=len(starts))
    before = np.append(False, letter[:-1])
    keep = letter | before
    code = np.where(letter, lowered(points), 0).astype(np.uint32)[keep]
    seg = segment_of[keep].astype(np.int64)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    left, right = np.append(np.uint32(0), code[:-1]), np.append(code[1:], np.uint32(0))
    mid = np.flatnonzero(code)
    c0, c1, c2, s = left[mid], code[mid], right[mid], seg[mid] << _BITS
    one, two, three = c1 * np.uint32(0x85EBCA77), c0 * np.uint32(0x9E3779B1), c2 * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - _BITS)
    if len(starts) <= 1 << (32 - _BITS):
        s = s.astype(np.uint32)
    grams = np.concatenate([s | (h >> shift).astype(s.dtype) for h in (one ^ np.uint32(0x27D4EB2F), one ^ two ^ np.uint32(0x165667B1), one ^ two ^ three)])
    grams.sort()
    grams = grams[np.append(True, grams[1:] != grams[:-1])]
    return (grams >> _BITS).astype(np.int64), (grams & ((1 << _BITS) - 1)).astype(np.int64), letters


@dataclass
class KernelModel:
    """languages; row of each n-gram in ``weights`` (-1: of no landmark); weights by n-gram and language.

    ``sharpness`` scales the margin that makes a sentence foreign; ``temperature`` turns scores into probabilities that hold for unseen sentences.
    """

    languages: tuple[str, ...]
    row: np.ndarray
    weights: np.ndarray
    sharpness: float = 1.0
    temperature: float = 1.0

    @property
    def fitted(self) -> bool:
        return bool((self.row >= 0).any())

    def score(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(regression outputs by segment and language, letters by segment)."""
        seg, gram, letters = gram_presences(points, starts)
        own = np.bincount(seg, minlength=len(starts))
        row = self.row[gram]
        seg, row = seg[row >= 0], row[row >= 0]
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        if len(seg):
            at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            out[seg[at]] = np.add.reduceat(self.weights[row], at, axis=0)
        return out / np.sqrt(np.maximum(own, 1))[:, None].astype(np.float32), letters


def _dense(seg: np.ndarray, gram: np.ndarray, n: int, row: np.ndarray, width: int) -> np.ndarray:
    """Presence vectors of unit length over the landmarks' n-grams."""
    out = np.zeros((n, width), np.float32)
    known = row[gram] >= 0
    out[seg[known], row[gram[known]]] = 1
    return out / np.sqrt(np.maximum(np.bincount(seg, minlength=n), 1))[:, None]


def _by_segment(seg: np.ndarray, gram: np.ndarray, wanted: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the wanted segments, which are numbered anew."""
    number = np.full(n, -1)
    number[wanted] = np.arange(len(wanted))
    keep = number[seg] >= 0
    order = np.argsort(number[seg[keep]], kind="stable")
    return number[seg[keep]][order], gram[keep][order]


def fit(texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES, landmarks: int = 80, per_language: int = 1200, ridge: float = 0.1, rounds: int = 3) -> KernelModel:
    """Fits on labelled texts, each sentence with its text's label.

    ``landmarks`` and ``per_language`` bound the sentences of a language used as landmarks and for the
    regression. Labels may err: a phrase takes the label most of its texts have, and after
    the first round sentences that the model puts elsewhere are left out.
    """
    known = [(t, languages.index(x)) for t, x in zip(texts, labels, strict=True) if t and x in languages]
    points, offsets = code_points(pa.array([t + "\n" for t, _ in known], pa.large_string()))
    starts, rows = segments(points, offsets)
    y = np.array([x for _, x in known], np.int64)[rows] if known else np.zeros(0, np.int64)
    letters = np.add.reduceat((classes(points) & 1).astype(np.int64), starts) if len(starts) else y
    wordless = np.add.reduceat((classes(points) & 8 > 0).astype(np.int64), starts) * 2 > letters if len(starts) else letters > 0
    order = np.random.default_rng(7).permutation(len(starts))
    order = order[letters[order] >= np.where(wordless[order], 6, 15)]
    # a phrase that many texts repeat counts once, with the label most of them have
    letter = (classes(points) & 1) > 0
    limits = np.append(starts, len(points))
    phrase: dict[bytes, np.ndarray] = {}
    keys = [points[limits[i] : limits[i + 1]][letter[limits[i] : limits[i + 1]]].tobytes() for i in order]
    for i, key in zip(order, keys, strict=True):
        phrase.setdefault(key, np.zeros(len(languages)))[y[i]] += 1
    chosen, room = [], np.full(len(languages), 2 * per_language)
    for i, key in zip(order, keys, strict=True):
        count = phrase.pop(key, None)
        if count is not None and count.max() > 0.6 * count.sum() and room[k := int(count.argmax())] > 0:
            y[i] = k
            room[k] -= 1
            chosen.append((count.sum() < 3, i))
    chosen.sort(key=lambda x: x[0])  # phrases of several texts, whose label is sure, first
    sure = ~np.array([x for x, _ in chosen], bool)
    order = np.array([i for _, i in chosen], np.int64)
    ends = limits[order + 1]
    parts = [np.append(points[a:b], np.uint32(10)) for a, b in zip(starts[order], ends, strict=True)]
    y = y[order]
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype(np.int64)
    points = np.concatenate(parts) if parts else points[:0]
    order = np.arange(len(starts))
    seg, gram, _ = gram_presences(points, starts)
    model = KernelModel(tuple(languages), np.full(1 << _BITS, -1, np.int32), np.zeros((1, len(languages)), np.float32))
    guess = None
    for stiffness in [ridge * 30.0 ** (rounds - 1 - r) for r in range(rounds)]:  # stiff at first, so that no wrong label is learnt by heart
        usable = order if guess is None else order[sure | (guess[order] == y[order])]
        per = [usable[y[usable] == k] for k in range(len(languages))]
        marks = np.concatenate([p[:landmarks] for p in per])
        train = np.concatenate([p[:per_language] for p in per])
        if not len(marks):
            return model
        mseg, mgram = _by_segment(seg, gram, marks, len(starts))
        row = np.full(1 << _BITS, -1, np.int32)
        vocabulary = np.unique(mgram)
        row[vocabulary] = np.arange(len(vocabulary))
        z = _dense(mseg, mgram, len(marks), row, len(vocabulary))
        value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
        good = value > 1e-6
        root = vector[:, good] / np.sqrt(value[good])
        phi = np.concatenate([_dense(*_by_segment(seg, gram, part, len(starts)), len(part), row, len(vocabulary)) @ z.T for part in np.array_split(train, max(1, len(train) // 400))]).astype(np.float64) @ root
        target = np.where(y[train][:, None] == np.arange(len(languages)), 1.0, -1.0)
        weight = (1 / np.sqrt(np.maximum(np.bincount(y[train], minlength=len(languages)), 1)))[y[train]]
        weight *= len(train) / weight.sum()
        gram_matrix = phi.T @ (phi * weight[:, None]) + stiffness * np.eye(phi.shape[1])
        beta = np.linalg.solve(gram_matrix, phi.T @ (target * weight[:, None]))
        model = KernelModel(tuple(languages), row, (z.T @ (root @ beta)).astype(np.float32))
        scores, _ = model.score(points, starts)
        guess = scores.argmax(1)
        margin = np.sort(scores[train], axis=1)
        model.sharpness = float(np.clip(4.0 / max(1e-3, np.median(margin[:, -1] - margin[:, -2])), 1, 20)) if margin.shape[1] > 1 else 1.0
    # sentences of the regression without their own part in it, the others as they are
    leverage = np.minimum((phi @ np.linalg.inv(gram_matrix) * phi).sum(1) * weight, 0.99)[:, None]
    unseen = scores.astype(np.float64)
    unseen[train] = (phi @ beta - leverage * target) / (1 - leverage)
    model.temperature = best_temperature(unseen[order], y[order])
    return model


def best_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The scale of ``scores``, each by a regression without its sentence, whose softmax has the least log loss for the labels ``y``, of which an unknown share is wrong."""
    scales, wrong = np.geomspace(0.25, 64, 40), (0.001, 0.01, 0.02, 0.05, 0.1)
    p = [_softmax(scores, s)[np.arange(len(y)), y] for s in scales]
    loss = [[-np.log(np.maximum((1 - w) * x + w / scores.shape[1], 1e-12)).mean() for w in wrong] for x in p]
    return float(scales[int(np.argmin(np.min(loss, axis=1)))])


def _softmax(scores: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(sharpness * (scores - scores.max(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


RESULT = "main_lang string, confidence double, other_lang string, other_confidence double, passages array<struct<start:int,length:int,lang:string,confidence:double>>"


def classify_batch(model: KernelModel, text: pa.Array, sure: float = 0.8, least_letters: int = 12, least_wordless: int = 5) -> dict[str, list]:
    """``RESULT`` by column for a batch of texts.

    The main language is that of most sentences, then of the higher summed score; a sentence of another language is a
    passage if it has enough letters and its own language outweighs the main one by a margin that ``sure`` states in odds. Confidence is
    the probability of the language, of a record the mean over its sentences.
    """
    points, offsets = code_points(text)
    n = len(text)
    starts, rows = segments(points, offsets)
    scores, letters = model.score(points, starts) if len(starts) else (np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64))
    k = len(model.languages)
    best = scores.argmax(1) if len(starts) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(points)))
    wordless = np.add.reduceat((classes(points) & 8 > 0).astype(np.int64), starts) * 2 > letters if len(starts) else np.zeros(0, bool)
    enough = letters >= np.where(wordless, least_wordless, least_letters)
    has = (np.bincount(rows[letters > 0], minlength=n) > 0) & model.fitted
    # short sentences only count where a record has no longer one
    long_there = np.bincount(rows[enough], minlength=n) > 0
    counts_for = (letters > 0) & (enough | ~long_there[rows])
    votes = np.zeros((n, k))
    np.add.at(votes, (rows[counts_for], best[counts_for]), 1)
    total = np.stack([np.bincount(rows[counts_for], scores[counts_for, j], minlength=n) for j in range(k)], 1) if k else votes
    main = (votes + 1e-3 * np.tanh(total / np.maximum(votes.sum(1, keepdims=True), 1))).argmax(1)
    here = np.arange(len(starts))
    margin = model.sharpness * (scores[here, best] - scores[here, main[rows]])
    foreign = model.fitted & enough & (best != main[rows]) & (margin >= np.log(sure / (1 - sure)))
    p = _softmax(scores, model.temperature)
    own = p[here, best]
    confidence = np.bincount(rows[counts_for], p[counts_for, main[rows[counts_for]]], minlength=n) / np.maximum(np.bincount(rows[counts_for], minlength=n), 1)
    other: list[str] = [""] * n
    other_confidence: list[float | None] = [None] * n
    passages: list[list[dict]] = [[] for _ in range(n)]
    for i in np.flatnonzero(foreign):
        r, c = rows[i], float(own[i])
        passages[r].append({"start": int(starts[i] - offsets[r]), "length": int(lengths[i]), "lang": model.languages[best[i]], "confidence": c})
        if other_confidence[r] is None or c > other_confidence[r]:
            other[r], other_confidence[r] = model.languages[best[i]], c
    return {"main_lang": [model.languages[m] if h else None for m, h in zip(main, has, strict=True)], "confidence": [float(c) if h else None for c, h in zip(confidence, has, strict=True)], "other_lang": other, "other_confidence": other_confidence, "passages": passages}


def label_language(lang: str | Column) -> Column:
    """The part of a language label before ``-`` or ``_`` in lower case; null for null, empty and ``und``."""
    base = F.lower(F.btrim(F.regexp_extract(F.col(lang) if isinstance(lang, str) else lang, r"^[^-_]*", 0)))
    return F.when(base.isin("", "und"), None).otherwise(base)


def _joined(text_columns: list[str]) -> Column:
    return F.concat(*[F.concat(F.coalesce(F.col(c), F.lit("")), F.lit("\n")) for c in text_columns])


def fit_on(df: DataFrame, record_id: str, text_columns: list[str], lang: str, languages: tuple[str, ...] = LANGUAGES, sample: int = 12_000, sample_chars: int = 16_000_000, **how) -> KernelModel:
    """Fits on ``sample`` labelled rows at most, of about ``sample_chars`` characters together: those of smallest hashed id, a sample that doesn't depend on the partitions."""
    labelled = df.where(label_language(lang).isin(*languages)).select(F.xxhash64(F.col(record_id)).alias("h"), _joined(text_columns).alias("t"), label_language(lang).alias("l"))
    # ids hash evenly, so the smallest lie below this bound; without it each task would send as many rows to the driver
    size = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    part = min(1.0, (1.1 * sample + 1000) / max(1, size.n), sample_chars / max(1, size.chars))
    rows = labelled.where(F.col("h") <= min(2**63 - 1, int(part * 2**64) - 2**63)).orderBy("h", "t").limit(sample).select("t", "l").collect()
    return fit([r.t for r in rows], [r.l for r in rows], languages, **how)


def _classifier(model: KernelModel, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = classify_batch(model, b.column("_text"))
                kinds = [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], names=[*names, *found])

    return run


def identify(df: DataFrame, record_id: str, text_columns: list[str], lang: str, languages: tuple[str, ...] = LANGUAGES, model: KernelModel | None = None) -> DataFrame:
    """(record_id, label, main_lang, confidence, other_lang, other_confidence, passages) of every row.

    ``label`` is the language of the delivered label (see ``label_language``). Texts are read whole, title and all; null texts
    count as empty. A row without letters has null main_lang and confidence; without a foreign sentence other_lang is ``''``.
    Passages give start and length in the text columns joined by newlines. Without labelled rows main_lang and
    confidence are null. Rows that repeat, ids or texts, are classified each; other
    columns are ignored. The model goes to the tasks; its size is bounded by the number of landmarks.
    """
    model = model or fit_on(df, record_id, text_columns, lang, languages)
    kind = dict(df.dtypes)[record_id]
    rows = df.select(F.col(record_id).alias("record_id"), label_language(lang).alias("label"), _joined(text_columns).alias("_text"))
    return rows.mapInArrow(_classifier(model, ["record_id", "label"]), f"record_id {kind}, label string, {RESULT}")


def wrong_or_mixed(identified: DataFrame) -> DataFrame:
    """(record_id, main_lang, other_lang) of rows that hold a foreign sentence or whose label is missing or not the main language."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("main_lang"))
    return identified.where(F.col("main_lang").isNotNull() & (wrong | (F.col("other_lang") != ""))).select("record_id", "main_lang", "other_lang")
