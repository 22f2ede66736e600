import json
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.plans import export, report, topics
from feedloom.sinks import files
from feedloom.sources import forum as source
from feedloom.streaming import feed

ROOT = Path(__file__).resolve().parents[1]
ROWS = [
    (10, "slug-a", "Error with plate", 87, "2025-01-01", 8000, 25, 15, ["bed", "noise"], False, False),
    (11, "slug-b", "How to level?", 93, "2025-01-02", 100, 0, 0, [], False, False),
    (10, "slug-c", "Later copy", 87, "2025-01-03", 9, 9, 9, ["bed"], True, True),
    (12, "slug-d", "Please add a lamp", 1, "2025-01-04", 700, 3, 9, ["bed"], False, False),
    (13, "slug-e", "Hello", 92, "2025-01-05", 700, 3, 9, None, False, True),
    (14, "slug-f", "fail fail", 87, "2025-01-06", 8000, 25, 15, ["noise"], True, False),
]


@pytest.fixture
def frames(spark):
    raw = source.from_rows(spark, ROWS)
    category = spark.createDataFrame([(87, "Main"), (93, "Help"), (92, "Show")], "category_id int, category_name string")
    official = spark.createDataFrame([(11,), (11,), (99,)], "topic_id bigint")
    texts = spark.createDataFrame([(1, 10, "code 0003-0522-0005-0006 v1.2.3"), (2, 10, "second"), (3, 12, "x" * 2500), (4, 14, None)], "record_id bigint, topic_id bigint, problem_description string")
    t = topics.topics(raw, category, official, base_url="https://example.org")
    s = topics.summaries(texts)
    return t, topics.issues(t, s), topics.features(t, s), s


def test_topics(frames):
    t = {r.topic_id: r for r in frames[0].collect()}
    assert len(t) == 5 and t[10].title == "Error with plate" and t[10].url == "https://example.org/t/slug-a/10"
    assert t[12].category_name == "Unknown" and t[12].topic_type == "feature_request"
    assert t[11].has_official_response and t[11].official_response_count == 1 and t[11].resolution_status.startswith("🟡")
    assert t[10].created_at == "2025-01-01T00:00:00Z" and t[10].posts_count == 26
    assert t[13].resolution_status.startswith("🔒") and t[14].resolution_status.startswith("✅")
    assert len(frames[0].columns) == 25


def test_issues_and_rollup(frames):
    issues = {r.topic_id: r for r in frames[1].collect()}
    assert set(issues) == {10, 11, 14} and issues[10].engagement_score == 175.0
    assert issues[10].error_codes == ["0003-0522-0005-0006"] and issues[10].versions_mentioned == ["1.2.3"] or issues[10].versions_mentioned == ["v1.2.3"]
    assert issues[14].problem_description == "" and len(frames[1].columns) == 22
    roll = {r.theme: (r.issues, r.unresolved, r.hot_title) for r in topics.theme_rollup(frames[1]).collect()}
    assert roll == {"bed": (1, 1, "Error with plate"), "noise": (2, 1, "Error with plate"), "uncategorized": (1, 0, "How to level?")}
    assert [r.theme for r in report.top_themes(frames[1]).orderBy("place").collect()] == ["noise", "bed", "uncategorized"]
    assert [(r.code, r.mentions) for r in report.error_index(frames[1]).collect()] == [("0003-0522-0005-0006", 1)]


def test_features_and_unified(frames):
    f = frames[2].collect()
    assert [(r.topic_id, r.total_support, len(r.description)) for r in f] == [(12, 9, 500)]
    u = {r.feedback_id: r for r in topics.unified(frames[0], frames[3], frames[1]).collect()}
    assert u["forum_topic_12"].text_length == 2500 and len(u["forum_topic_12"].text) == 2000
    assert u["forum_topic_13"].text == "Hello" and u["forum_topic_13"].parent_id is None
    assert u["forum_topic_10"].error_codes == ["0003-0522-0005-0006"] and u["forum_topic_11"].error_codes == []
    assert u["forum_topic_11"].engagement_score == 0.0 and len(topics.unified(frames[0], frames[3], frames[1]).columns) == 23


def test_report(frames, tmp_path):
    lines = report.report_lines(frames[0], frames[1], frames[2], "2025-02-01 10:00", "test")
    files.write_report(lines, str(tmp_path / "report.md"))
    text = (tmp_path / "report.md").read_text(encoding="utf-8")
    assert [int(x) for x in re.findall(r"^## (\d)", text, re.M)] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert "| 总主题帖 | 5 |" in text and "| 总浏览量（估算） | 17,500 |" in text and "### 1. Please add a lamp" in text
    empty = report.report_lines(frames[0].limit(0), frames[1].limit(0), frames[2].limit(0), "-", "-")
    assert "## 7" not in "".join(r.text for r in empty.collect())


def test_sinks(frames, tmp_path, spark):
    n = files.write_json_array(frames[1], str(tmp_path / "issues.json"), topics.issue_order(), drop=["ord"])
    rows = json.loads((tmp_path / "issues.json").read_text(encoding="utf-8"))
    assert n == 3 and [r["topic_id"] for r in rows] == [10, 14, 11] and list(rows[0])[0] == "topic_id"
    assert files.write_json_array(frames[1].limit(0), str(tmp_path / "none.json"), topics.issue_order()) == 0
    assert json.loads((tmp_path / "none.json").read_text()) == []
    files.write_json_lines(frames[0].select("topic_id", F.lit(None).cast("string").alias("nothing")), str(tmp_path / "lines"))
    assert all('"nothing":null' in r.value for r in spark.read.text(str(tmp_path / "lines")).collect())
    assert [name for name, _ in files.listing(str(tmp_path))] == ["issues.json", "none.json"]
    assert files.listing_frame(spark, str(tmp_path / "lines")).count() >= 1


def test_workbook(frames, tmp_path):
    pd, _ = pytest.importorskip("pandas"), pytest.importorskip("openpyxl")
    files.write_workbook({"a": frames[2], "none": frames[2].limit(0)}, str(tmp_path / "w.xlsx"))
    assert list(pd.read_excel(tmp_path / "w.xlsx", sheet_name=None)) == ["a"]
    with pytest.raises(ValueError, match="rows at most"):
        files.write_workbook({"a": frames[0]}, str(tmp_path / "w.xlsx"), most_rows=2)


def test_a_missing_library_is_no_silent_success(frames, tmp_path, monkeypatch):
    monkeypatch.setitem(sys.modules, "openpyxl", None)
    with pytest.raises(ImportError):
        files.write_workbook({"a": frames[2]}, str(tmp_path / "w.xlsx"))


def test_statistics(frames):
    t, i, f, s = frames
    lines = report.statistics_lines(report.statistics(t, i, f, topics.unified(t, s, i)))
    assert "  topics: 5" in lines and "  [  9 support] Please add a lamp" in lines and "  neutral: 3 (60.0%)" in lines and "  bed: 2" in lines


def test_export(spark, tmp_path, capsys):
    category = spark.createDataFrame([(87, "Main")], "category_id int, category_name string")
    official = spark.createDataFrame([(11,)], "topic_id bigint")
    summary = spark.createDataFrame([(10, "text")], "topic_id bigint, summary string")
    wrote = dict(export.export(source.from_rows(spark, ROWS), category, official, summary, str(tmp_path), "-", "test"))
    assert {"analysis_report.md", "all_topics.json", "issue_list.json", "feature_requests.json", "unified_feedback.json"} <= set(wrote)
    assert "topic types:" in capsys.readouterr().out
    rows = json.loads((tmp_path / "data" / "all_topics.json").read_text(encoding="utf-8"))
    assert [r["topic_id"] for r in rows] == [10, 11, 12, 13, 14] and len(rows[0]) == 24
    assert len(json.loads((tmp_path / "data" / "unified_feedback.json").read_text(encoding="utf-8"))[0]) == 22
    export.export_lines(source.from_rows(spark, ROWS), category, official, summary, str(tmp_path / "lines"))
    assert [spark.read.json(str(tmp_path / "lines" / x)).count() for x in ("all_topics", "issue_list", "feature_requests", "unified_feedback", "full_index")] == [5, 3, 1, 5, 5]


def test_pages(spark, tmp_path):
    page = {"topic_list": {"topics": [{"id": 5, "slug": "s", "title": "T", "category_id": 1, "created_at": "2025-03-04T01:02:03Z", "views": 1, "posts_count": 3, "like_count": 2, "tags": ["x"]}, {"id": 6, "slug": "u", "title": "U"}]}}
    (tmp_path / "page.json").write_text(json.dumps(page))
    got = source.from_pages(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.topic_id, r.date_str, r.replies, r.has_accepted) for r in got] == [(5, "2025-03-04", 2, False), (6, None, None, False)]
    for n in (2, 10):
        (tmp_path / f"page_{n}.json").write_text(json.dumps({"topic_list": {"topics": [{"id": 100 * n + i} for i in range(3)]}}))
    got = source.from_pages(spark, str(tmp_path / "page_*.json")).orderBy("ord").collect()
    assert [(r.ord, r.topic_id) for r in got] == list(enumerate([200, 201, 202, 1000, 1001, 1002]))
    with pytest.raises(ValueError, match="11 fields"):
        source.from_rows(spark, [(1, 2)])


def test_stream(spark, tmp_path):
    source.from_rows(spark, ROWS).write.parquet(str(tmp_path / "in"))
    stream = feed.classified_stream(spark.readStream.schema(source.RAW_TOPIC).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("classified_topics").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.topic_id: r.topic_type for r in spark.table("classified_topics").collect()}
    assert set(got) == {10, 11, 12, 13, 14} and got[13] == "showcase"
    windows = feed.theme_windows(spark.table("classified_topics"))
    assert {r.theme for r in windows.collect()} == {"bed", "noise"}


def test_nothing_outside_imports_the_text_subpackage():
    for p in [*(ROOT / "feedloom").rglob("*.py")]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert "feedloom.llm" not in p.read_text(encoding="utf-8")


def test_queries_match_their_sql(spark, sf):
    import duckdb

    from feedloom.plans import catalogue
    from tools.compare import canon

    db = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    for name in ("p2_found", "p3_found", "p5_found", "theme_rollup", "unified_feed", "feature_requests", "listed_code_index", "report_lines", "statistics", "unified_table", "issue_table"):
        got, want = catalogue.QUERIES[name](spark, sf).toPandas(), db.execute(catalogue.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want), name
