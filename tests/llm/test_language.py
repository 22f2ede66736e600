import random

import numpy as np
import pyarrow as pa

from feedloom.llm import language as L

WORDS = {
    "en": "the printer stops without any message when this belt moves and nobody knows what happens with that fan".split(),
    "de": "der drucker bleibt einfach stehen wenn sich dieser riemen bewegt und niemand weiß was mit dem lüfter passiert".split(),
    "fr": "cette imprimante ne répond plus quand la courroie du portique bouge et personne ne sait pourquoi elle chauffe".split(),
    "es": "esta impresora no responde cuando la correa del eje se mueve y nadie sabe qué pasa con el ventilador".split(),
    "zh": list("打印机完全没有反应的时候皮带总是卡住而且没有人知道发生了什么事情"),
}


def sentence(lang, rnd):
    words = rnd.sample(WORDS[lang], 9)
    return ("".join(words) + "。") if lang == "zh" else " ".join(words).capitalize() + ". "


def rows(seed, n=500):
    rnd, out = random.Random(seed), []
    for i in range(n):
        main = rnd.choice(list(WORDS))
        other = rnd.choice([x for x in WORDS if x != main]) if i % 10 == 0 else ""
        body = "".join(sentence(main, rnd) for _ in range(4)) + (sentence(other, rnd) if other else "")
        label = rnd.choice([None, "", "und"]) if i % 12 == 1 else rnd.choice(list(WORDS)) if i % 12 == 2 else rnd.choice([main, main.upper(), f"{main}-XX", f"{main}_yy"])
        out.append((i, sentence(main, rnd).strip(" ."), body, label, "clash", main, other))
    return out


SCHEMA = "record_id bigint, title string, problem_description string, lang string, main_lang string, truth string, truth_other string"


def test_planted_languages(spark):
    data = rows(1)
    got = {r.record_id: r for r in L.identify(spark.createDataFrame(data, SCHEMA).drop("truth"), "record_id", ["title", "problem_description"], "lang").collect()}
    right = [got[r[0]].main_lang == r[5] and got[r[0]].other_lang == r[6] for r in data]
    assert sum(right) >= 0.98 * len(data)
    mixed = next(r for r in data if r[6] and got[r[0]].other_lang == r[6])
    p = got[mixed[0]].passages[0]
    whole = mixed[1] + "\n" + mixed[2]
    assert p.lang == mixed[6] and whole[p.start : p.start + p.length].strip() in mixed[2] and 0 < p.confidence <= 1


def test_cases_follow_label_and_passages(spark):
    data = rows(2)
    df = L.identify(spark.createDataFrame(data, SCHEMA), "record_id", ["title", "problem_description"], "lang")
    want = {r[0] for r in data if r[6] or (r[3] or "und").lower()[:2] != r[5] or r[3] in (None, "", "und")}
    got = {r.record_id for r in L.wrong_or_mixed(df).collect()}
    assert len(got ^ want) <= 0.03 * len(data)


def test_edges(spark):
    data = [(1, None, None, None, "", "", ""), (2, "!!!", "90, 57", "en", "", "", ""), (3, "", "https://a.example/x 12 @me", None, "", "", ""), (4, "The printer stops", None, "en", "", "", ""), (4, "The printer stops", None, "en", "", "", "")]
    got = L.identify(spark.createDataFrame(data, SCHEMA), "record_id", ["title", "problem_description"], "lang").collect()
    assert [(r.record_id, r.main_lang) for r in got if r.record_id < 4] == [(1, None), (2, None), (3, None)]
    assert sum(r.record_id == 4 for r in got) == 2
    empty = L.identify(spark.createDataFrame([], SCHEMA), "record_id", ["title", "problem_description"], "lang")
    assert empty.count() == 0 and L.wrong_or_mixed(empty).count() == 0


def test_a_very_long_text():
    rnd = random.Random(3)
    model = L.fit([sentence(x, rnd) for x in WORDS for _ in range(60)], [x for x in WORDS for _ in range(60)])
    text = "".join(sentence("de", rnd) for _ in range(5000)) + sentence("fr", rnd)
    found = L.classify_batch(model, pa.array([text, "", sentence("zh", rnd)]))
    assert found["main_lang"] == ["de", None, "zh"] and found["other_lang"][0] == "fr"


def test_gram_presences():
    points, _ = L.code_points(pa.array(["abc abd\n"]))
    seg, gram, letters = L.gram_presences(points, np.array([0]))
    # a, b, c, d; the pairs _a, ab, bc, bd; the triples _ab, abc, bc_, abd, bd_, each once
    assert len(gram) == 4 + 4 + 5 and letters[0] == 6 and set(seg) == {0}


def test_a_score_is_the_sum_of_the_weights_of_its_grams():
    rnd = random.Random(4)
    texts = [sentence(x, rnd) for x in WORDS for _ in range(40)]
    model = L.fit(texts, [x for x in WORDS for _ in range(40)])
    points, offsets = L.code_points(pa.array([t + "\n" for t in texts[::20]]))
    starts, _ = L.segments(points, offsets)
    seg, gram, _ = L.gram_presences(points, starts)
    scores, _ = model.score(points, starts)
    for i in range(len(starts)):
        mine = gram[seg == i]
        rows = model.row[mine]
        want = model.weights[rows[rows >= 0]].sum(0) / np.sqrt(max(1, len(mine)))
        assert np.allclose(scores[i], want, atol=1e-4)


def test_sentences():
    points, offsets = L.code_points(pa.array(["One. Two (three.) Four 1.0.0 five!\n中文。日本「語。」", "x"]))
    starts, rows = L.segments(points, offsets)
    text = "".join(map(chr, points))
    parts = [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    assert [p for p in parts if p] == ["One.", "Two (three.)", "Four 1.0.0 five!", "中文。", "日本「語。」", "x"] and rows[-1] == 1


def test_label_language(spark):
    df = spark.createDataFrame([("EN-us",), ("pt_BR",), (" de ",), ("und",), ("",), (None,), ("UND-x",)], "l string")
    assert [r.x for r in df.select(L.label_language("l").alias("x")).collect()] == ["en", "pt", "de", None, None, None, None]


def test_without_labels_nothing_is_said(spark):
    df = spark.createDataFrame([(1, "Der Drucker druckt nicht.", "Hello there.", None), (2, None, None, "xx")], "record_id bigint, title string, problem_description string, lang string")
    got = L.identify(df, "record_id", ["title", "problem_description"], "lang")
    assert all(r.main_lang is None and r.confidence is None and r.other_lang == "" and r.passages == [] for r in got.collect())
    assert L.wrong_or_mixed(got).count() == 0


def test_confidence_holds_for_unseen_sentences():
    rnd = random.Random(11)
    # short sentences of words that languages share, so that some can't be told
    some = lambda x: " ".join(rnd.choice(WORDS[x] if rnd.random() < 0.6 else ["printer", "firmware", "log", "test", "plan"]) for _ in range(4)).capitalize() + "."
    names = [x for x in WORDS if x not in ("zh", "ja")][:4]
    labels = [x for x in names for _ in range(300)]
    model = L.fit([some(x) for x in labels], labels)
    unseen = [x for x in names for _ in range(300)]
    found = L.classify_batch(model, pa.array([some(x) for x in unseen]))
    right = np.mean([a == b for a, b in zip(found["main_lang"], unseen, strict=True)])
    assert abs(np.mean(found["confidence"]) - right) < 0.08


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the printer " * 50, None, "en") for i in range(400)], "record_id bigint, title string, problem_description string, lang string")
    got = []
    monkeypatch.setattr(L, "fit", lambda texts, *a, **how: got.append(sum(map(len, texts))))
    L.fit_on(df, "record_id", ["title", "problem_description"], "lang", sample_chars=60_000)
    assert 20_000 < got[0] < 110_000
