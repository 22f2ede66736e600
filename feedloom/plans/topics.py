"""From raw topics to classified topics, issues, feature requests and the unified feedback feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import columns as C
from feedloom.functions import rules as R
from feedloom.operators.ranking import percentile_score
from feedloom.operators.relational import flagged, keep_first, left_lookup

BASE_URL = "https://talk.korvane.example"


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def deduplicated(raw: DataFrame) -> DataFrame:
    """The first row of each topic_id in list order (``ord``)."""
    return keep_first(raw, ["topic_id"], "ord")


def enriched(raw: DataFrame, category: DataFrame, base_url: str = BASE_URL) -> DataFrame:
    """Deduplicated topics as named rows: category name or ``Unknown``, posts, timestamps and url; ``ord`` stays."""
    t = left_lookup(deduplicated(raw), category, "category_id", "category_name", F.lit("Unknown"), "category_name")
    stamp = F.concat(F.col("date_str"), F.lit("T00:00:00Z"))
    return t.select(
        "ord", "topic_id", "title", "category_id", "category_name", stamp.alias("created_at"), stamp.alias("last_posted_at"),
        (F.col("replies") + 1).alias("posts_count"), F.col("replies").alias("reply_count"), "views", F.col("likes").alias("like_count"),
        F.lit(False).alias("pinned"), "closed", "tags", "slug", F.concat_ws("/", F.lit(base_url), F.lit("t"), F.col("slug"), F.col("topic_id")).alias("url"),
        F.col("has_accepted").alias("has_accepted_answer"),
    )


def topics(raw: DataFrame, category: DataFrame, official: DataFrame, rules: R.TopicRules | None = None, base_url: str = BASE_URL) -> DataFrame:
    """All 24 topic columns, and ``ord``: enriched, classified, with official responses and resolution status."""
    rules = rules or R.TopicRules()
    t = flagged(enriched(raw, category, base_url), official, "topic_id", "has_official_response")
    t = t.withColumn("_c", C.classified("title", "category_id", rules)).select("*", "_c.*").drop("_c")
    return t.withColumns(
        {
            "topic_type_label": C.lookup(rules.labels, F.col("topic_type"), F.lit(rules.labels[rules.fallback])),
            "themes": F.col("tags"),
            "official_response_count": F.col("has_official_response").cast("int"),
            "official_responders": _no_strings(),
            "resolution_status": C.resolution("has_accepted_answer", "closed", "has_official_response", "topic_type"),
        }
    )


def summaries(texts: DataFrame, topic_id: str = "topic_id", text: str = "problem_description", order: str = "record_id") -> DataFrame:
    """(topic_id, summary): the first non-empty text of each topic."""
    some = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(topic_id).alias("topic_id"), F.col(text).alias("summary"), F.col(order).alias("order_"))
    return keep_first(some, ["topic_id"], "order_").select("topic_id", "summary")


def issues(all_topics: DataFrame, summary: DataFrame) -> DataFrame:
    """The 21 issue columns, and ``ord``: problems and questions with codes, versions, score and description. ``summary`` has a topic once."""
    t = left_lookup(all_topics.where(F.col("topic_type").isin(*R.ISSUE_TYPES)), summary, "topic_id", "summary", F.lit(""), "summary", once=True)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("summary"))
    return t.select(
        "ord", "topic_id", "title", "url", F.col("category_name").alias("category"), "topic_type", "topic_type_label", "themes", "created_at",
        F.col("last_posted_at").alias("last_active"), "views", "reply_count", "like_count", C.issue_engagement("views", "reply_count", "like_count").alias("engagement_score"),
        "resolution_status", "has_official_response", "official_responders", C.error_codes(text).alias("error_codes"), C.versions(text).alias("versions_mentioned"),
        C.cut("summary", 1000).alias("problem_description"), F.lit("").alias("author"), _no_strings().alias("top_solutions"),
    )


def issue_order() -> list[Column]:
    """Highest engagement first, then list order."""
    return [F.col("engagement_score").desc(), F.col("ord").asc()]


def features(all_topics: DataFrame, summary: DataFrame) -> DataFrame:
    """The 13 feature request columns, and ``ord``. ``summary`` has a topic once."""
    t = left_lookup(all_topics.where(F.col("topic_type") == "feature_request"), summary, "topic_id", "summary", F.lit(""), "summary", once=True)
    return t.select(
        "ord", "topic_id", "title", "url", "themes", "created_at", "views", "reply_count", "like_count", F.lit(0).cast("bigint").alias("support_signals"),
        F.col("like_count").alias("total_support"), C.cut("summary", 500).alias("description"), "has_official_response", "resolution_status",
    )


def theme_rollup(issue_rows: DataFrame, empty: str = "uncategorized") -> DataFrame:
    """(theme, issues, unresolved, hot_title, hot_url, first): issues by theme, those without one under ``empty``.

    The hottest issue is the first of highest score; ``first`` (score negated, list place, position) settles themes of equal counts.
    """
    themed = F.when(F.coalesce(F.size("themes"), F.lit(-1)) > 0, F.col("themes")).otherwise(F.array(F.lit(empty)))
    e = issue_rows.select("engagement_score", "ord", "title", "url", "resolution_status", F.posexplode(themed).alias("pos", "theme"))
    rank = [(-F.col("engagement_score")).alias("s"), F.col("ord")]
    hot = F.min(F.struct(*rank, "pos", "title", "url"))
    unresolved = F.count_if(F.col("resolution_status").contains(R.UNANSWERED_MARK))
    g = e.groupBy("theme").agg(F.count(F.lit(1)).alias("issues"), unresolved.alias("unresolved"), hot.alias("h"))
    return g.select("theme", "issues", "unresolved", F.col("h.title").alias("hot_title"), F.col("h.url").alias("hot_url"), F.struct("h.s", "h.ord", "h.pos").alias("first"))


def unified(all_topics: DataFrame, summary: DataFrame, issue_rows: DataFrame, vendor: str | None = None) -> DataFrame:
    """The 22 feedback columns, and ``ord``: text or title, language, sentiment, feedback type, percentile score and the issue's codes. ``summary`` has a topic once."""
    t = left_lookup(all_topics, summary, "topic_id", "summary", F.coalesce(F.col("title"), F.lit("")), "summary", once=True)
    codes = issue_rows.select(F.col("topic_id").alias("_id"), F.col("error_codes").alias("_codes"))
    t = t.join(codes, t["topic_id"] == codes["_id"], "left")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("summary"))
    rows = t.select(
        "ord", F.concat(F.lit("forum_topic_"), F.col("topic_id")).alias("feedback_id"), F.lit("forum").alias("platform"), F.col("url").alias("source_url"),
        F.lit("").alias("author"), "created_at", C.cut("summary", 2000).alias("text"), F.length("summary").cast("bigint").alias("text_length"),
        C.simple_language(text).alias("language"), "themes", C.sentiment(text, vendor).alias("sentiment"), C.feedback_type("topic_type", "themes").alias("feedback_type"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(False).alias("is_reply"), "like_count", "reply_count", F.col("views").alias("view_count"),
        F.lit(False).alias("is_official"), "resolution_status", F.coalesce("_codes", _no_strings()).alias("error_codes"), F.col("title").alias("thread_title"), F.lit(False).alias("has_image"),
    )
    return percentile_score(rows, C.raw_engagement("view_count", "reply_count", "like_count"), "engagement_score")
