"""The stateless part of the pipeline on a stream of raw topics, and theme counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import columns as C
from feedloom.functions import rules as R


def classified_stream(raw: DataFrame, rules: R.TopicRules | None = None, late: str = "30 days") -> DataFrame:
    """Raw topics with day, type and confidence; a topic_id seen within ``late`` is passed on once, whichever row comes first."""
    t = raw.withColumn("day", F.to_timestamp("date_str", "yyyy-MM-dd")).withWatermark("day", late).dropDuplicatesWithinWatermark(["topic_id"])
    return t.withColumn("_c", C.classified("title", "category_id", rules)).select("topic_id", "title", "category_id", "day", "views", "replies", "likes", "tags", "_c.*")


def theme_windows(classified: DataFrame, width: str = "30 days") -> DataFrame:
    """(window, theme, topics, views) for a stream of ``classified_stream`` rows; topics without tags add nothing."""
    t = classified.select("day", "views", F.explode("tags").alias("theme"))
    return t.groupBy(F.window("day", width), "theme").agg(F.count(F.lit(1)).alias("topics"), F.sum("views").alias("views"))
