"""The whole pipeline into a folder: four JSON files, the report and, where its library is there, the workbook."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import rules as R
from feedloom.plans import report, topics
from feedloom.session import written
from feedloom.sinks import files


def _one_each(summary: DataFrame) -> DataFrame:
    """(topic_id, summary) with a topic once, its smallest summary."""
    return written(summary.where(F.col("topic_id").isNotNull()).groupBy("topic_id").agg(F.min("summary").alias("summary")), "summaries")


def export(raw: DataFrame, category: DataFrame, official: DataFrame, summary: DataFrame, folder: str, generated: str, source: str, rules: R.TopicRules | None = None, base_url: str = topics.BASE_URL, vendor: str | None = None) -> list[tuple[str, int]]:
    """Writes everything under ``folder`` (on the driver), prints the statistics and gives (name, bytes) of what is there.

    ``data`` holds all_topics, issue_list, feature_requests and unified_feedback as JSON arrays in list or rank order and the workbook,
    ``reports`` the report. Topics, issues and the feed are written to the shared folder once, since the outputs start from them. For results that
    people read: ``export_lines`` writes tables of any size. Without the workbook's library a message stands for it.
    """
    data, reports = Path(folder, "data"), Path(folder, "reports")
    data.mkdir(parents=True, exist_ok=True)
    reports.mkdir(parents=True, exist_ok=True)
    all_topics, summary = written(topics.topics(raw, category, official, rules, base_url), "topics"), _one_each(summary)
    issue_rows, feature_rows = written(topics.issues(all_topics, summary), "issues"), topics.features(all_topics, summary)
    feed = written(topics.unified(all_topics, summary, issue_rows, vendor), "feed")
    by_place, by_support = [F.col("ord").asc()], [F.col("total_support").desc(), F.col("ord").asc()]
    files.write_report(report.report_lines(all_topics, issue_rows, feature_rows, generated, source), str(reports / "analysis_report.md"))
    outputs = {
        "all_topics": (all_topics, by_place),
        "issue_list": (issue_rows, topics.issue_order()),
        "feature_requests": (feature_rows, by_support),
        "unified_feedback": (feed, by_place),
    }
    for name, (frame, order) in outputs.items():
        files.write_json_array(frame, str(data / f"{name}.json"), order, drop=["ord"])
    sheets = {"全部主题": all_topics.orderBy(*by_place), "问题清单": issue_rows.orderBy(*topics.issue_order()), "功能需求": feature_rows.orderBy(*by_support)}
    try:
        files.write_workbook({k: v.drop("ord") for k, v in sheets.items()}, str(data / "forum_data.xlsx"))
    except (ImportError, ValueError) as e:
        print(f"no workbook: {e}")
    print("\n".join(report.statistics_lines(report.statistics(all_topics, issue_rows, feature_rows, feed))))
    return files.listing(str(reports)) + files.listing(str(data))


def export_lines(raw: DataFrame, category: DataFrame, official: DataFrame, summary: DataFrame, path: str, rules: R.TopicRules | None = None, base_url: str = topics.BASE_URL, vendor: str | None = None) -> None:
    """The four tables and the full index as folders of JSON Lines under ``path``, written by the tasks."""
    all_topics, summary = written(topics.topics(raw, category, official, rules, base_url), "topics"), _one_each(summary)
    issue_rows = written(topics.issues(all_topics, summary), "issues")
    outputs = {
        "all_topics": all_topics, "issue_list": issue_rows, "feature_requests": topics.features(all_topics, summary),
        "unified_feedback": topics.unified(all_topics, summary, issue_rows, vendor), "full_index": report.full_index(all_topics),
    }
    for name, frame in outputs.items():
        files.write_json_lines(frame.drop("ord"), f"{path}/{name}")
