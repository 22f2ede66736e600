import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import contamination as X


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(values):
    ids = np.array(values)
    assert X.suffix_array(ids, 64).tolist() == sorted(range(len(ids)), key=lambda i: values[i:])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.lists(st.integers(-1, 2), min_size=1, max_size=15), st.integers(1, 4))
def test_longest_matches(corpus, query, least):
    ids, q = np.array(corpus), np.array(query)
    left = np.arange(len(q), 0, -1)
    got = {tuple(map(int, x)) for x in zip(*X.longest_matches(ids, X.suffix_array(ids, 32), q, left, least), strict=True)}
    want = set()
    for i in range(len(q)):
        for j in range(len(ids)):
            n = 0
            while i + n < len(q) and j + n < len(ids) and q[i + n] == ids[j + n] and q[i + n] >= 0:
                n += 1
            if n >= least and not (i and j and q[i - 1] == ids[j - 1] and q[i - 1] >= 0):
                want.add((i, j, n))
    assert got == want


def test_extend_counts_edits():
    p = list(range(20))
    assert X.extend(p, p, 2)[0] == 20
    changed = p[:5] + [99] + p[6:]
    assert X.extend(p, changed, 2)[:2] == [5, 20]
    assert X.extend(p, p[:5] + p[6:], 1) == [5, 20]
    assert X.extend(p, [*p[:5], 99, *p[5:]], 1) == [5, 20]
    assert X.extend(p, [], 1) == [0, 0] and X.extend([], p, 1) == [0, 0]


def words(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


ITEMS = "item_id bigint, passage string, text string"
DOCS = "doc_id bigint, text string, passage string"


def test_planted_leaks(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(words(rnd, 60)), None) for i in range(40)]
    items += [(40, items[0][1], None), (41, None, None), (42, "", None), (43, "too short", None)]
    docs, want = [], set()
    for d in range(400):
        noise, i = words(rnd, 40), rnd.randrange(40)
        quote, kind = items[i][1].split()[10:40], d % 8
        if kind == 1:
            quote = quote[:15]
        elif kind == 2:
            quote[7], quote[20] = "changed", "twice"
        elif kind == 3:
            del quote[14]
        elif kind == 4:
            quote = quote[:9]
        elif kind == 5:
            quote = [w if k % 4 else "other" for k, w in enumerate(quote)]
        elif kind == 6:
            quote = [f"<b>{w.upper()}</b>," if k % 3 else w[:2] + "​" + w[2:] + "\n> " for k, w in enumerate(quote)]
        elif kind == 7:
            quote = []
        docs.append((d, " ".join(noise[:20] + quote + noise[20:]), "clash"))
        if kind in (0, 1, 2, 3, 6):
            want |= {(i, d)} | ({(40, d)} if i == 0 else set())
    docs += [(500, None, None), (501, "", None), (0, docs[0][1], None), (None, docs[0][1], None), (502, " ".join(words(rnd, 200_000)) + " " + items[3][1], None)]
    want |= {(3, 502)} | {(i, None) for i, d in want if d == 0}
    df = spark.createDataFrame(docs, DOCS)
    for how in ({}, {"block_chars": 2000}):
        got = X.leaks(df, spark.createDataFrame(items, ITEMS), **how)
        assert {(r.item_id, r.doc_id) for r in got.collect()} == want
    clean = X.without_leaks(df, got)
    assert {r.doc_id for r in clean.collect()} == {d for d, _, _ in docs} - {d for _, d in want if d is not None}
    assert {r.item_id for r in X.leaked_items(got).collect()} == {i for i, _ in want}


def test_one_array_a_shard_for_all_blocks(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    items = [(i, " ".join(words(rnd, 40)), None) for i in range(60)]
    docs = [(d, " ".join(words(rnd, 30)) + " " + items[d % 60][1], None) for d in range(120)]
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    blocks = []
    searcher = X._searcher
    monkeypatch.setattr(X, "_searcher", lambda b, *a: blocks.append(len(b)) or searcher(b, *a))
    got = X.leaks(df, spark.createDataFrame(items, ITEMS), block_chars=5000)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == {(d % 60, d) for d in range(120)}
    # one search over the documents, whatever the number of blocks, and only paths in its plan
    assert len(blocks) == 1 and blocks[0] >= 3


def test_many_items_with_one_passage(spark):
    rnd = random.Random(9)
    passage = " ".join(words(rnd, 40))
    got = X.leaks(spark.createDataFrame([(7, "x " + passage, None)], DOCS), spark.createDataFrame([(i, passage, None) for i in range(500)], ITEMS))
    assert {r.item_id for r in got.collect()} == set(range(500))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_no_stretch_is_ruled_out(seed):
    rnd = random.Random(seed)
    n = rnd.randint(15, 60)
    passage = list(range(n))
    quote, edits = passage[:], n // 10
    for at in sorted(rnd.sample(range(1, n - 1), edits), reverse=True):
        kind = rnd.randrange(3)
        quote[at : at + 1] = [[-7], [], [-8, passage[at]]][kind]
    text = np.array([-5] * rnd.randint(0, 30) + quote + [-6] * rnd.randint(0, 30))
    runs = []
    for q in range(n):
        for c in np.flatnonzero(text == q):
            k = 0
            while q + k < n and c + k < len(text) and text[c + k] == q + k:
                k += 1
            if k >= 6 and (q == 0 or c == 0 or text[c - 1] != q - 1):
                runs.append((q, int(c), k))
    p = np.array(passage)
    reached = [X.best_stretch(p, text, q, c, k, 10) for q, c, k in runs if k >= 15 or X.may_reach(p, text, q, k)]
    every = [X.best_stretch(p, text, q, c, k, 10) for q, c, k in runs]
    assert max((w for w, _ in reached), default=0) >= 15 or max((w for w, _ in every), default=0) < 15


def test_markup(spark):
    texts = ["a <b>word</b> and <a href=\"x y\" id=k>link</a><br/>&nbsp;end", "a <b and words> stay", "x < y > z", "<" + "q " * 5000 + ">"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.plain("t").alias("t")).collect()]
    assert got[0].split() == ["a", "word", "and", "link", "end"] and got[1] == "a <b and words> stay" and got[2] == "x < y > z" and got[3].split()[1] == "q"


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "")], DOCS), spark.createDataFrame([(1, "a " * 30, "")], ITEMS)
    assert X.leaks(docs.limit(0), items).count() == 0
    assert X.leaks(docs, items.limit(0)).count() == 0
