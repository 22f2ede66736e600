"""Queries of the numbered general problems (2, 3 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.terms import terms
from feedloom.operators.cooccurrence import associations
from feedloom.operators.frequency import marked_terms
from feedloom.operators.topn import skipping_report, top_n
from feedloom.session import read_table

TERM_FIELDS = ["error_codes", "themes", "versions_mentioned"]
#: Bytes of a row group of p5: most categories' themes are small, so only small row groups hold one of them alone.
_ROW_GROUP = 4 << 10


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common, by field."""
    return p2_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every field with its occurrences, records and mark."""
    return marked_terms(read_table(spark, sf_dir, "issue_list"), TERM_FIELDS)


def _theme_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [read_table(spark, sf_dir, t).select(terms("themes").alias("themes")) for t in ("issue_list", "feature_requests")]
    return tables[0].unionByName(tables[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of themes in 5 records and a thousandth of all at least, three times as often as by chance or more."""
    strong = F.col("together") * F.col("total") >= 3 * F.col("n_a") * F.col("n_b")
    frequent = associations(_theme_baskets(spark, sf_dir), "themes", min_records=5, min_share=(1, 1000))
    return frequent.where(strong).select(F.col("item_a").alias("theme_a"), F.col("item_b").alias("theme_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of themes with its counts and lift."""
    scored = associations(_theme_baskets(spark, sf_dir), "themes")
    return scored.select(F.col("item_a").alias("theme_a"), F.col("item_b").alias("theme_b"), "together", "n_a", "n_b", "total", "lift")


def _theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = read_table(spark, sf_dir, "issue_list").where(F.col("category").isNotNull() & F.col("engagement_score").isNotNull())
    return issues.select("category", F.explode(terms("themes")).alias("theme"), "engagement_score", "record_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three records of highest engagement for every category and theme."""
    best = top_n(_theme_scores(spark, sf_dir), ["category", "theme"], "engagement_score", "record_id", 3, _ROW_GROUP)
    return best.select("category", "theme", "place", "record_id")


def p5_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups and row groups opened by ``p5_found``, per clustered file."""
    return skipping_report(_theme_scores(spark, sf_dir), ["category", "theme"], "engagement_score", "record_id", 3, _ROW_GROUP).select("row_groups", "opened")


QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms, "p3_found": p3_found, "p3_pairs": p3_pairs, "p5_found": p5_found, "p5_skipping": p5_skipping}

_TERM = "lower(trim(t, ' ' || chr(9)))"
_OCCURRENCES = " union all ".join(f"select '{f}' as field_name, record_id, {_TERM} as term from (select record_id, unnest({f}) as t from issue_list)" for f in TERM_FIELDS)
_MARKED = f"""
with o as (select * from ({_OCCURRENCES}) where term <> ''),
c as (select field_name, term, count(*) as occurrences, count(distinct record_id) as records from o group by all)
select field_name, term, occurrences, records,
  case when records <= 2 then 'rare' when records * 10 > (select count(*) from issue_list) then 'common' end as mark
from c"""
_PAIRS = f"""
with r as (select 'i' || record_id as rid, themes from issue_list union all select 'f' || record_id, themes from feature_requests),
k as (select distinct rid, {_TERM} as term from (select rid, unnest(themes) as t from r) where {_TERM} <> ''),
c as (select term, count(*) as n from k group by term),
p as (select a.term as theme_a, b.term as theme_b, count(*) as together from k a join k b on a.rid = b.rid and a.term < b.term group by all)
select theme_a, theme_b, together, ca.n as n_a, cb.n as n_b, (select count(*) from r) as total,
  together / (ca.n::double * cb.n / (select count(*) from r)) as lift
from p join c ca on ca.term = theme_a join c cb on cb.term = theme_b"""

ORACLE = {
    "p2_terms": _MARKED,
    "p2_found": f"select field_name, term, mark from ({_MARKED}) where mark is not null",
    "p3_pairs": _PAIRS,
    "p3_found": f"select theme_a, theme_b from ({_PAIRS}) where together >= 5 and together * 1000 >= total and together * total >= 3 * n_a * n_b",
    "p5_found": f"""
with k as (select distinct category, {_TERM} as theme, engagement_score, record_id
  from (select category, unnest(themes) as t, engagement_score, record_id from issue_list where category is not null and engagement_score is not null)
  where {_TERM} <> ''),
r as (select *, row_number() over (partition by category, theme order by engagement_score desc, record_id) as place from k)
select category, theme, place::int as place, record_id from r where place <= 3""",
}
