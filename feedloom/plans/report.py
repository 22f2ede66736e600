"""The Markdown report as rows (section, line, text): bounded tables and the full topic index, each built by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import columns as C
from feedloom.functions import rules as R
from feedloom.operators.ranking import numbered
from feedloom.operators.relational import distribution, exploded_counts, inverted_index
from feedloom.plans.topics import issue_order, theme_rollup


def kpis(all_topics: DataFrame) -> DataFrame:
    """One row of totals over all topics; of no topics all are 0."""
    kind = lambda t: F.count_if(F.col("topic_type") == t).alias(t)
    return all_topics.agg(
        F.count(F.lit(1)).alias("topics"), F.coalesce(F.sum("posts_count"), F.lit(0)).alias("posts"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
        kind("problem_error"), kind("question_howto"), kind("feature_request"), F.count_if("has_official_response").alias("official"),
        F.count_if(F.col("resolution_status").contains(R.UNANSWERED_MARK)).alias("unanswered"),
    )


def top(df: DataFrame, order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows in ``order`` (without ties) with their place; only ``n`` rows meet in one task."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _by_count(d: DataFrame, most: int) -> DataFrame:
    """Rows of a ``distribution`` over at most ``most`` fixed values with their ``place``: by count, ties by first encounter."""
    return top(d, [F.col("n").desc(), F.col("first").asc()], most)


def type_distribution(all_topics: DataFrame) -> DataFrame:
    """(place, topic_type, label, n, pct, bar)."""
    d = _by_count(distribution(all_topics, "topic_type", "ord"), len(R.LABELS) + 1)
    return d.select("place", "topic_type", C.lookup(R.LABELS, F.col("topic_type"), F.col("topic_type")).alias("label"), "n", "pct", C.bar(F.col("pct")).alias("bar"))


def resolution_distribution(all_topics: DataFrame) -> DataFrame:
    """(place, resolution_status, n, pct)."""
    return _by_count(distribution(all_topics, "resolution_status", "ord"), 5)


def top_themes(issue_rows: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` themes of most issues; ties by their first issue."""
    return top(theme_rollup(issue_rows), [F.col("issues").desc(), F.col("first").asc()], n)


def error_index(issue_rows: DataFrame) -> DataFrame:
    """(code, mentions, title, url, status) by error code, with the hottest issue that mentions it."""
    order = [(-F.col("engagement_score")).alias("s"), F.col("ord")]
    i = inverted_index(issue_rows, "error_codes", order, ["title", "url", "resolution_status"])
    return i.select(F.col("item").alias("code"), F.col("postings").alias("mentions"), F.col("first.title").alias("title"), F.col("first.url").alias("url"), F.col("first.resolution_status").alias("status"))


def full_index(all_topics: DataFrame) -> DataFrame:
    """Every topic with its place by views, then list order."""
    return numbered(all_topics, [F.col("views").desc(), F.col("ord").asc()], "place")


def _lines(df: DataFrame, section: int, line: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), line.cast("bigint").alias("line"), text.alias("text"))


def report_lines(all_topics: DataFrame, issue_rows: DataFrame, feature_rows: DataFrame, generated: str, source: str) -> DataFrame:
    """The report's lines; order by section and line. The code index is left out where no issue mentions a code."""
    spark = all_topics.sparkSession
    say = lambda s, *t: spark.createDataFrame([(s, i - len(t), x) for i, x in enumerate(t)], "section int, line bigint, text string")
    fmt = F.format_string
    k = kpis(all_topics)
    unanswered = issue_rows.where(F.col("resolution_status").contains(R.UNANSWERED_MARK))
    names = [("总主题帖", "topics"), ("总帖子数（含回复，估算）", "posts"), ("总浏览量（估算）", "views"), ("问题/报错帖", "problem_error"), ("疑问/求助帖", "question_howto"), ("功能建议帖", "feature_request"), ("有官方回应", "official"), ("暂无官方回应", "unanswered")]
    kpi = k.select(F.posexplode(F.array(*[F.concat(F.lit(f"| {n} | "), C.thousands(c) if c == "views" else F.col(c).cast("string"), F.lit(" |")) for n, c in names])).alias("line", "text"))
    kinds = type_distribution(all_topics)
    official = F.when(F.col("has_official_response"), "✅").otherwise("❌")
    icon = F.when(F.col("topic_type") == "problem_error", "🔴").otherwise("🟡")
    status = lambda c: C.cut(c, 5)
    hot = top(issue_rows, issue_order(), 20)
    waiting = top(unanswered, issue_order(), 15)
    wanted = top(feature_rows, [F.col("total_support").desc(), F.col("ord").asc()], 10)
    summary = F.when(F.col("problem_description") != "", fmt("- **问题摘要**: %s...\n", C.cut("problem_description", 300))).otherwise("")
    codes = error_index(issue_rows)
    n_codes, n_waiting = codes.count(), unanswered.count()
    parts = [
        say(0, "# 用户问题与反馈分析报告\n", f"**生成时间**: {generated}", f"**数据来源**: {source}"),
        say(1, "## 1. 数据概览\n", "| 指标 | 数值 |", "|---|---|"), _lines(kpi, 1, F.col("line"), F.col("text")),
        say(2, "## 2. 帖子类型分布\n"), _lines(kinds, 2, F.col("place"), fmt("- %s: %d (%s%%) %s", "label", "n", F.bround("pct", 0).cast("int").cast("string"), "bar")),
        say(3, "## 3. 高频问题主题（按问题数量排序）\n", "| 排名 | 主题 | 问题数 | 未回应 | 高热帖 |", "|---|---|---|---|---|"),
        _lines(top_themes(issue_rows), 3, F.col("place"), fmt("| %d | %s | %d | %d | [%s...](%s) |", "place", "theme", "issues", "unresolved", C.cut("hot_title", 30), "hot_url")),
        say(4, "## 4. 热门问题 Top 20（按热度排序）\n", "| # | 类型 | 标题 | 浏览 | 回复 | 状态 | 官方 | 链接 |", "|---|---|---|---|---|---|---|---|"),
        _lines(hot, 4, F.col("place"), fmt("| %d | %s | %s | %s | %d | %s | %s | [→](%s) |", "place", icon, C.cut("title", 40), C.thousands("views"), "reply_count", status("resolution_status"), official, "url")),
        say(5, f"## 5. 暂无官方回应的问题（{n_waiting} 个）\n", "按热度排序，以下问题可能需要优先关注：\n"),
        _lines(waiting, 5, F.col("place"), fmt("### %d. %s\n\n- **链接**: %s\n- **浏览/回复**: %s / %d\n- **主题**: %s\n%s", "place", "title", "url", C.thousands("views"), "reply_count", C.joined("themes", "未分类"), summary)),
        say(6, "## 6. 用户功能需求/建议 Top 10\n"),
        _lines(wanted, 6, F.col("place"), fmt("### %d. %s %s\n\n- **链接**: %s\n- **支持度**: %d（%d 赞）\n- **描述**: %s...\n", "place", "title", F.when(F.col("has_official_response"), "（官方已回应）").otherwise(""), "url", "total_support", "like_count", C.cut("description", 200))),
        say(8, "## 8. 全部主题索引\n", "| # | 类型 | 标题 | 板块 | 浏览 | 回复 | 状态 | 主题标签 |", "|---|---|---|---|---|---|---|---|"),
        _lines(full_index(all_topics), 8, F.col("place"), fmt("| %d | %s | [%s](%s) | %s | %s | %d | %s | %s |", "place", C.cut("topic_type_label", 2), C.cut("title", 35), "url", C.cut("category_name", 15), C.thousands("views"), "reply_count", status("resolution_status"), C.joined(F.slice("themes", 1, 3), "-"))),
    ]
    if n_codes:
        listed = numbered(codes, [F.col("code").asc()], "place")
        parts += [
            say(7, f"## 7. 已知错误码索引（{n_codes} 个）\n", "| 错误码 | 相关帖子数 | 状态 | 最相关帖 |", "|---|---|---|---|"),
            _lines(listed, 7, F.col("place"), fmt("| `%s` | %d | %s | [%s...](%s) |", "code", "mentions", status("status"), C.cut("title", 35), "url")),
        ]
    return reduce(DataFrame.unionByName, parts)


def statistics(all_topics: DataFrame, issue_rows: DataFrame, feature_rows: DataFrame, feed: DataFrame) -> DataFrame:
    """(section, place, label, n, pct) of the figures an export prints: output sizes, distributions, most frequent themes, requests of most support."""
    spark = all_topics.sparkSession
    sizes = [("topics", all_topics), ("issues", issue_rows), ("feature requests", feature_rows), ("feedback items", feed)]
    counts = spark.createDataFrame([(i, name, df.count()) for i, (name, df) in enumerate(sizes, 1)], "place bigint, label string, n bigint")

    def part(section: str, df: DataFrame, label: str | Column, n: str = "n", pct: bool = False) -> DataFrame:
        share = F.col("pct") if pct else F.lit(None).cast("double")
        return df.select(F.lit(section).alias("section"), "place", (F.col(label) if isinstance(label, str) else label).alias("label"), F.col(n).cast("bigint").alias("n"), share.alias("pct"))

    feature = F.concat(F.lit("["), C.padded("total_support", 3), F.lit(" support] "), C.cut("title", 60))
    by_feed = lambda key: _by_count(distribution(feed, key, "ord"), 10)
    tags = top(exploded_counts(feed, "themes", "ord"), [F.col("n").desc(), F.col("first").asc()], 10)
    parts = [
        part("outputs", counts, "label"),
        part("topic types", type_distribution(all_topics), "label", pct=True),
        part("resolution", resolution_distribution(all_topics), "resolution_status", pct=True),
        part("issue themes", top_themes(issue_rows, 10), "theme", "issues"),
        part("feature requests", top(feature_rows, [F.col("total_support").desc(), F.col("ord").asc()], 10), feature, "total_support"),
        part("feedback types", by_feed("feedback_type"), "feedback_type", pct=True),
        part("themes", tags, "item"),
        part("sentiments", by_feed("sentiment"), "sentiment", pct=True),
    ]
    return reduce(DataFrame.unionByName, parts)


def statistics_lines(figures: DataFrame) -> list[str]:
    """``statistics`` as text, a few dozen lines."""
    lines, last = [], None
    number = F.when(F.col("pct").isNull(), F.col("n").cast("string")).otherwise(F.format_string("%d (%s%%)", "n", F.bround("pct", 1).cast("string")))
    text = F.when(F.col("section") == "feature requests", F.col("label")).otherwise(F.concat("label", F.lit(": "), number))
    for r in figures.select("section", "place", text.alias("text")).orderBy("section", "place").collect():
        if r.section != last:
            lines.append(f"{r.section}:")
            last = r.section
        lines.append(f"  {r.text}")
    return lines
