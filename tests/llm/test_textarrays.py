import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm.textarrays import classes, code_points, lowered, span_hashes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=8), st.integers(0, 3))
def test_code_points(values, skip):
    values = [None if v is None else v.encode("utf-8", "replace").decode() for v in values]
    points, offsets = code_points(pa.array(values, pa.string()).slice(skip))
    got = ["".join(map(chr, points[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == [v or "" for v in values[skip:]]


def test_classes_and_case():
    points, _ = code_points(pa.array(["aÉ 7中ひ​🙂\U00020000"]))
    assert classes(points).tolist() == [1, 1, 4, 2, 9, 9, 16, 0, 9]
    assert "".join(map(chr, lowered(points)[:2])) == "aé"


def test_span_hashes():
    points, offsets = code_points(pa.array(["word other word", "🙂word"]))
    h = span_hashes(points, np.array([0, 5, 11, 16]), np.array([4, 10, 15, 20]))
    assert h[0] == h[2] == h[3] and h[0] != h[1]
