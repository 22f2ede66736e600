import random

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import abuse as A

THINGS, DOES, TAILS = ["the fan", "the belt", "my printer", "the plate", "this nozzle"], ["stops", "rattles", "gets warm", "stays cold"], ["after two hours", "on tall parts", "near the corner", "again"]
INSULTS = ["you {a} {n}, go away", "shut up, you {n}", "nobody wants you here, {a} {n}", "you are a {a} {n}"]
ADJ, NOUN = ["filthy", "worthless", "brainless"], ["gronk", "zurbel", "flemmer", "drang"]


def neutral(rnd):
    return f"{rnd.choice(THINGS)} {rnd.choice(DOES)} {rnd.choice(TAILS)}".capitalize() + "."


def insult(rnd):
    return rnd.choice(INSULTS).format(a=rnd.choice(ADJ), n=rnd.choice(NOUN)).capitalize() + "."


def data(seed, n, every=20):
    rnd, texts, bad = random.Random(seed), [], []
    for i in range(n):
        s = [neutral(rnd) for _ in range(rnd.randint(2, 8))] + (["I feel like a gronk, the cable was loose."] if rnd.random() < 0.1 else [])
        if i % every == 0:
            s.insert(rnd.randrange(len(s)), insult(rnd))
        texts.append(" ".join(s))
        bad.append(i % every == 0)
    return texts, np.array(bad)


def verdicts(bad, seed, share=0.3):
    """(doc_id, verdict) of a part of the documents, more of the bad ones; raters err."""
    rnd = random.Random(seed)
    return [(i, "flagged" if (rnd.random() < 0.95) == bool(b) else "clean") for i, b in enumerate(bad) if rnd.random() < (0.6 if b else share)]


LABELS = "doc_id bigint, verdict string"


@pytest.fixture(scope="module")
def trained(spark):
    texts, bad = data(1, 2000)
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    return A.fit_on(d, spark.createDataFrame(verdicts(bad, 2), LABELS))


def severities(spark, model, texts):
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    return [r for r in A.scored_by(model, d).orderBy("doc_id").collect()]


def test_held_out_order(spark, trained):
    unseen, truth = data(3, 600)
    severity = np.array([r.severity for r in severities(spark, trained, unseen)])
    first = np.argsort(-severity)[: truth.sum()]
    assert truth[first].mean() >= 0.95
    assert (np.diff(trained.thresholds, axis=1) >= 0).all()


def test_severity_is_the_expected_grade_and_the_worst_sentence_is_given(spark, trained):
    text = "The fan stops again. Shut up, you gronk. My printer gets warm on tall parts."
    bad, empty, fine = severities(spark, trained, [text, "", "The fan stops again."])
    assert bad.severity == pytest.approx(bad.p_divided + bad.p_severe) and bad.p_divided >= bad.p_severe
    assert "gronk" in text[bad.worst_start : bad.worst_start + bad.worst_length]
    assert empty.worst_start == -1 and empty.severity == 0 and bad.severity > fine.severity


def features_of(text):
    points, _ = A.code_points(pa.array([text]))
    return set(A.features(points, np.array([0]))[1].tolist())


def test_disguises():
    plain = features_of("you idiot go")
    for other in ("you id1ot go", "you idi0t go", "you id​iot go", "YOU IDIOT GO", "you iiiiidiot go", "you i d i o t go", "you іdiоt go"):
        assert features_of(other) == plain, other
    assert features_of("layer 12 of 300") == features_of("layer 9 of 4")
    for empty in ("", " ", "?"):
        assert features_of(empty) == set()


def test_vocabulary():
    known = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    v, h, seg = A._Vocabulary(known), np.append(known[[5, 5, 7, 900]], np.arange(9000, dtype=np.uint64)), np.append([0, 0, 0, 3], np.full(9000, 4))
    assert [x.tolist() for x in v.among(seg, h)] == [[0, 0, 3], [5, 7, 900]]
    assert len(A._Vocabulary(known[:0]).among(seg, h)[0]) == 0


def test_features_bound_to_abuse():
    # of 10,000 documents 100 are flagged: one feature with many of them, one as frequent everywhere, one known from a single document
    documents, flagged, clean = np.array([20, 2000, 1]), np.array([8, 20, 1]), np.array([0, 100, 0])
    odds = A.bound_odds(documents, flagged, clean, 10_000, 100, 500)
    assert odds[0] > 2 and odds[1] == 0 and odds[2] == 0
    assert not A.bound_odds(documents, flagged * 0, clean, 10_000, 0, 500).any()


def test_in_spark(spark):
    texts, bad = data(1, 2000)
    docs = [(i, t, f"s{i % 3}", 1.0) for i, t in enumerate(texts)] + [(3000, None, None, 1.0), (3001, "", "s0", 1.0), (3002, "Fine. " * 20_000 + "You filthy gronk, go away.", "s1", 1.0), (0, texts[0], "s0", 1.0)]
    given = verdicts(bad, 2)
    labels = given + [(0, "flagged"), (0, "clean"), (5, None), (None, "flagged"), (9999, "flagged")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, severity double")
    scored = A.score(d, spark.createDataFrame(labels, LABELS))
    got = scored.collect()
    assert len(got) == len(docs)
    flagged = {r.doc_id for r in got if r.flagged}
    truth = set(np.flatnonzero(bad).tolist()) | {3002}
    assert len(flagged & truth) >= 0.95 * len(truth) and len(flagged - truth) <= 0.05 * len(flagged) and 3002 in flagged and not flagged & {3000, 3001}
    rates = {r.source: r for r in A.rates(scored).collect()}
    assert rates[None].documents == 1 and rates[None].rate == 0 and sum(r.documents for r in rates.values()) == len(docs)
    # the parts that tasks read don't matter
    again = A.score(d.repartition(7, "text"), spark.createDataFrame(labels, LABELS))
    assert {r.doc_id for r in again.where("flagged").collect()} == flagged


def test_without_documents_or_labels_of_both_kinds(spark):
    texts, bad = data(1, 60, 10)
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    for labels in ([], [(1, "clean")], [(0, "flagged")], [(0, "flagged"), (1, "clean")]):
        got = A.score(d, spark.createDataFrame(labels, LABELS))
        assert got.count() == 60 and got.columns[-1] == "worst_length"
        assert len(labels) == 2 or got.where("flagged").count() == 0
    assert A.score(d.limit(0), spark.createDataFrame([(0, "flagged"), (1, "clean")], LABELS)).count() == 0


def test_any_severity_may_be_the_cutoff():
    for low in (1e-6, 0.01, 0.9):
        severity = np.append(np.full(900, low / 4), np.full(100, low * 1.1))
        documents, flagged = (np.bincount(A.severity_bin(x, 3), minlength=A._BINS) for x in (severity, severity[900:]))
        assert low / 4 < A.bin_severity(A.best_cutoff(documents, flagged, documents * 0), 3) <= low * 1.1
    # labels that tell nothing: raters found more of any hits clean
    assert A.best_cutoff(documents, flagged, 2 * documents) == A._BINS and A.bin_severity(A._BINS, 3) == 2


def test_grades(spark):
    labels = spark.createDataFrame([(1, "clean"), (1, "Clean "), (2, "clean"), (2, "flagged"), (3, "flagged"), (4, None), (5, "else")], LABELS)
    assert {r.doc_id: r.grade for r in A.graded(labels).collect()} == {1: 0, 2: 1, 3: 2}
