"""Sources: raw topics from rows, tables, or saved pages of a forum's JSON interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.ranking import running_total
from feedloom.session import written

RAW_TOPIC = "ord bigint, topic_id bigint, slug string, title string, category_id int, date_str string, views bigint, replies bigint, likes bigint, tags array<string>, has_accepted boolean, closed boolean"
_PAGE = "topic_list struct<topics:array<struct<id:bigint,slug:string,title:string,category_id:int,created_at:string,views:bigint,posts_count:bigint,like_count:bigint,tags:array<string>,has_accepted_answer:boolean,closed:boolean>>>"


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Raw topics from 11-field rows in list order; a row of another length raises."""
    if any(len(r) != 11 for r in rows):
        raise ValueError("a raw topic has 11 fields")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RAW_TOPIC)


def from_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw topics from saved category pages, one JSON document a file, in the order of the pages.

    Pages stand in the order of their paths, numbers in a path by value: page 2 before page 10. Places in a page keep their order. ``ord`` counts on over
    the pages from the number of topics in those before, one row a page.
    """
    pages = spark.read.schema(_PAGE).json(path, multiLine=True).withColumn("_file", F.input_file_name())
    pages = written(pages.select("_file", F.coalesce("topic_list.topics", F.array()).alias("t")).withColumn("_n", F.size("t")), "pages")
    numbers = F.transform(F.regexp_extract_all("_file", F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))
    upto = running_total(pages.select("_file", "_n", F.array_join(numbers, "").alias("_key")), [F.col("_key").asc(), F.col("_file").asc()], F.col("_n"), "_upto")
    t = pages.join(upto.select("_file", "_upto"), "_file").select(F.col("_upto") - F.col("_n"), F.posexplode("t").alias("pos", "t")).toDF("before", "pos", "t")
    return t.select(
        (F.col("before") + F.col("pos")).alias("ord"), F.col("t.id").alias("topic_id"), "t.slug", "t.title", "t.category_id", F.substring("t.created_at", 1, 10).alias("date_str"), "t.views",
        (F.col("t.posts_count") - 1).alias("replies"), F.col("t.like_count").alias("likes"), F.coalesce("t.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("t.has_accepted_answer", F.lit(False)).alias("has_accepted"), F.coalesce("t.closed", F.lit(False)).alias("closed"),
    )
