import pytest
from pyspark.sql import functions as F

from feedloom.functions import columns as C
from feedloom.functions import rules as R


def one(spark, values, types, column):
    return [r.v for r in spark.createDataFrame(values, types).select(column.alias("v")).collect()]


CASES = [
    ("Error with plate", 87, "problem_error", "medium"),
    ("Can't connect, error", 87, "problem_error", "high"),
    ("Any suggestion", 87, "feature_request", "high"),
    ("Can we make suggestions?", 87, "question_howto", "high"),
    ("Custom firmware feature", 87, "feature_request", "medium"),
    ("Setup of the plate?", 93, "question_howto", "high"),
    ("How does this error happen?", 93, "problem_error", "high"),
    ("Which plate?", 93, "question_howto", "high"),
    ("Speed for travel moves", 93, "problem_error", "high"),
    ("Wiki updates", 93, "official_update", "high"),
    ("Lan mode setup", 87, "tip_guide", "medium"),
    ("Hello world", 87, "discussion", "low"),
    ("anything", 92, "showcase", "high"),
    ("anything", 91, "official_update", "high"),
    (None, 87, "discussion", "low"),
    ("Error", None, "problem_error", "medium"),
    ("", None, "discussion", "low"),
]


def test_classified(spark):
    got = one(spark, [(t, c) for t, c, _, _ in CASES], "t string, c int", C.classified("t", "c"))
    assert [(g.topic_type, g.type_confidence) for g in got] == [(k, s) for _, _, k, s in CASES]


def test_rules_are_whole():
    assert sum(map(len, R.PATTERNS.values())) == 88
    assert R.PATTERNS["feature_request"].count("suggestion") == 2


def test_classified_against_a_plain_loop(spark):
    import re

    titles = ["my first print of a basketball", "update: release note", "tip vs. trick guide?", "Is it broken", "showoff", "should add x to y", "s.a.m.m review", "0003-12 crash?"]
    rules = R.TopicRules()

    def plain(title, category):
        scores = {k: 2 * sum(bool(re.search(p, title.lower())) for p in ps) for k, ps in rules.patterns.items()}
        scores = {k: v for k, v in scores.items() if v}
        for k, v in rules.bonuses.get(category, {}).items():
            scores[k] = scores.get(k, 0) + v
        return max(scores, key=scores.get) if scores else "discussion"

    rows = [(t, c) for t in titles for c in (87, 93)]
    got = one(spark, rows, "t string, c int", C.classified("t", "c"))
    assert [g.topic_type for g in got] == [plain(t, c) for t, c in rows]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("This is great", "positive"), ("great but broken", "mixed"), ("return the unit", "negative"), ("hello", "neutral"), ("Highly recommended", "positive"), ("thanks Acme", "positive"), (None, "neutral"), ("", "neutral")],
)
def test_sentiment(spark, text, expected):
    assert one(spark, [(text,)], "t string", C.sentiment("t", vendor="Acme")) == [expected]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("", "unknown"), (None, "unknown"), ("ab中", "zh"), ("abcdefg中中中", "en"), ("das ist gut", "de"), ("listed limits", "de"), ("hello", "en"), (" ", "en")],
)
def test_simple_language(spark, text, expected):
    assert one(spark, [(text,)], "t string", C.simple_language("t")) == [expected]


def test_scores(spark):
    rows = [(8000, 25, 15), (25, 0, 0), (None, None, None)]
    types = "v bigint, r bigint, l bigint"
    assert one(spark, rows, types, C.issue_engagement("v", "r", "l")) == [175.0, 0.2, 0.0]
    assert one(spark, rows, types, C.raw_engagement("v", "r", "l")) == [265.0, 0.5, 0.0]


def test_resolution(spark):
    rows = [(True, True, True, "problem_error"), (False, True, True, "problem_error"), (False, False, True, "question_howto"), (False, False, False, "problem_error"), (False, False, True, "showcase"), (None, None, None, None)]
    got = one(spark, rows, "a boolean, c boolean, o boolean, t string", C.resolution("a", "c", "o", "t"))
    assert got == [R.SOLVED, R.CLOSED, R.ANSWERED, R.UNANSWERED, R.NOT_APPLICABLE, R.NOT_APPLICABLE]


def test_feedback_type(spark):
    rows = [("discussion", ["vs_competitor"]), ("discussion", []), ("discussion", None), ("problem_error", None), ("else", []), (None, None)]
    got = one(spark, rows, "t string, x array<string>", C.feedback_type("t", "x"))
    assert got == ["comparison", "info_sharing", "info_sharing", "problem", "info_sharing", "info_sharing"]


def test_extraction(spark):
    rows = [("10003-0522-0005-00061 and 1111-2222-3333-4444 1111-2222-3333-4444",), ("V1.0.0 v2.3.1-dev 1.2.3.4.5.6",), (None,), ("",)]
    assert one(spark, rows, "t string", C.error_codes(F.col("t"))) == [["0003-0522-0005-0006", "1111-2222-3333-4444", "1111-2222-3333-4444"], [], [], []]
    assert one(spark, rows, "t string", C.versions(F.col("t")))[1:] == [["V1.0.0", "v2.3.1", "1.2.3", "4.5.6"], [], []]


def test_formatting(spark):
    rows = [(1234567, ["a", "b"], "日本語テキスト"), (7, [], ""), (None, None, None)]
    types = "n bigint, x array<string>, t string"
    assert one(spark, rows, types, C.thousands("n")) == ["1,234,567", "7", None]
    assert one(spark, rows, types, C.joined("x", "-")) == ["a, b", "-", "-"]
    assert one(spark, rows, types, C.cut("t", 3)) == ["日本語", "", None]
    assert one(spark, rows, types, C.padded("n", 3)) == ["1234567", "  7", None]
