"""Queries of the numbered text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import abuse, contamination, language, mixing, truncation
from feedloom.session import read_table

_DESCRIPTIONS = (("issue_list", "problem_description"), ("feature_requests", "description"))


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [truncation.prepared(read_table(spark, sf_dir, t), t, "record_id", c, "source") for t, c in _DESCRIPTIONS]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose description lost its end."""
    return truncation.truncated(_descriptions(spark, sf_dir)).where("cut").select("table_name", "record_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut descriptions by table and source."""
    both = [read_table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "source") for t, _ in _DESCRIPTIONS]
    return truncation.rates(truncation.truncated(_descriptions(spark, sf_dir)), both[0].unionByName(both[1]))


def p1_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant lengths of the delivered descriptions in characters and bytes, markers and trailers included."""
    units = F.explode(F.create_map(F.lit("chars"), F.length("d").cast("bigint"), F.lit("bytes"), F.octet_length("d").cast("bigint"))).alias("unit", "length")
    parts = [read_table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.coalesce("source", F.lit("")).alias("source"), F.col(c).alias("d")) for t, c in _DESCRIPTIONS]
    found = truncation.length_hazards(parts[0].unionByName(parts[1]).where(F.length("d") > 0).select("table_name", "source", units))
    return found.select("table_name", "source", "unit", "width", "bin", "ended", "at_risk", "near_ended", "near_at_risk", "hazard", "around")


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "issue_list"), "record_id", ["title", "problem_description"], "lang")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a foreign sentence or a missing or wrong label."""
    return language.wrong_or_mixed(_identified(spark, sf_dir))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's language and foreign passages, with confidence."""
    return _identified(spark, sf_dir)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that hold their passage."""
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, with the number of documents."""
    return contamination.leaked_items(_leaks(spark, sf_dir))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and sources of the documents without test passages."""
    documents = read_table(spark, sf_dir, "documents")
    return contamination.without_leaks(documents.select("doc_id", "source"), _leaks(spark, sf_dir))


def p6_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that hold 15 words or more of their passage unchanged."""
    return _leaks(spark, sf_dir).where(F.col("longest_verbatim") >= 15).select("item_id", "doc_id")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every listed source."""
    return _mixture(spark, sf_dir)[1]


def p7_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of a mixture as large as all documents of listed sources, where the caps on repeats bind."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), total_tokens="corpus")[1]


def p7_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets, whole epochs and rests of every listed source by the delivered sizes in characters."""
    sizes = read_table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("available"))
    b = mixing.budgets(sizes, read_table(spark, sf_dir, "mix_targets"))
    return b.select("source", "share", F.col("max_repeats").cast("int").alias("max_repeats"), "available", "target", "budget", "epochs", "rest")


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual sentence."""
    return _abuse(spark, sf_dir).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity and worst sentence."""
    return _abuse(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of flagged documents by source."""
    return abuse.rates(_abuse(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p1_hazards": p1_hazards,
    "p4_found": p4_found,
    "p4_languages": p4_languages,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_clean": p6_clean,
    "p6_verbatim": p6_verbatim,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_full": p7_full,
    "p7_budgets": p7_budgets,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_LENGTHS = " union all ".join(
    f"select '{t}' as table_name, coalesce(source, '') as source, '{unit}' as unit, {size} as length from {t} where length({c}) > 0" for t, c in _DESCRIPTIONS for unit, size in (("chars", f"length({c})"), ("bytes", f"strlen({c})"))
)
_LONE = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{20000}-\x{31FFF}]"
_INVISIBLE = r"[\p{Cf}\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F]"


def _grams(table: str, key: str, text: str) -> str:
    """(key, g): every 15 words in a row of a text."""
    plain = f"replace(lower(regexp_replace({text}, '{contamination.MARKUP.replace(chr(39), chr(39) * 2)}', ' ', 'g')), 'ß', 'ss')"
    spaced = f"regexp_replace(regexp_replace({plain}, '{_INVISIBLE}', '', 'g'), '({_LONE})', ' \\1 ', 'g')"
    listed = f"select {key}, regexp_extract_all({spaced}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') as w from {table} where {text} <> ''"
    return f"select distinct {key}, array_to_string(w[i : i + 14], ' ') as g from (select {key}, w, unnest(range(1, len(w) - 13)) as i from ({listed}) where len(w) >= 15)"


_TARGETS = "select source, sum(greatest(coalesce(weight, 0), 0)) as w, max(greatest(coalesce(max_repeats, 0), 0)) as max_repeats from mix_targets where source is not null group by source"
ORACLE: dict[str, str] = {
    "p6_verbatim": f"select distinct item_id, doc_id from ({_grams('eval_items', 'item_id', 'passage')}) join ({_grams('documents', 'doc_id', 'text')}) using (g)",
    "p7_budgets": f"""
with t as ({_TARGETS}), s as (select source, sum(n_chars)::bigint as available from documents group by source),
l as (select t.source, w / (select sum(w) from t) as share, max_repeats, coalesce(available, 0) as available from t left join s using (source)),
c as (select *, available * max_repeats as cap from l),
b as (select *, floor(share * (select floor(min(cap / share)) from c where share > 0 and cap > 0) + 1e-6)::bigint as target from c),
d as (select *, least(target, cap) as budget from b)
select source, share, max_repeats, available, target, budget, case when available > 0 then budget // available else 0 end as epochs,
  budget - case when available > 0 then budget // available else 0 end * available as rest from d""",
    "p1_hazards": f"""
with lengths as ({_LENGTHS}),
bins as (select table_name, source, unit, width, length // width as bin, count(*) as ended from lengths, (values {", ".join(f"({w})" for w in truncation.WIDTHS)}) w(width) group by all),
risk as (select *, sum(ended) over (partition by table_name, source, unit, width order by bin desc)::bigint as at_risk from bins),
near as (
  -- a text of bin t is at risk in every bin up to t, so the neighbours from a to b count it for each of theirs that it reaches
  select x.table_name, x.source, x.unit, x.width, x.bin, x.ended, x.at_risk,
    sum(case when y.bin between x.bin - 12 and x.bin - 2 or y.bin between x.bin + 2 and x.bin + 12 then y.ended else 0 end)::bigint as near_ended,
    sum(y.ended * (greatest(0, least(x.bin - 2, y.bin) - greatest(x.bin - 12, 1 // x.width) + 1) + greatest(0, least(x.bin + 12, y.bin) - (x.bin + 2) + 1)))::bigint as near_at_risk
  from risk x join bins y using (table_name, source, unit, width) group by all),
h as (select *, ended / at_risk as hazard, least((near_ended + 0.5) / (near_at_risk + 1.0), 0.999) as around from near),
p as (select *, case when hazard > around then -at_risk * (least(hazard, 1 - 1e-12) * ln(least(hazard, 1 - 1e-12) / around) + (1 - least(hazard, 1 - 1e-12)) * ln((1 - least(hazard, 1 - 1e-12)) / (1 - around))) else 0.0 end as log_p from h),
k as (select *, row_number() over (partition by table_name, source order by log_p, unit, width, bin) as k, count(*) over (partition by table_name, source) as m from p),
d as (select *, max(case when log_p <= ln(0.001 * k / m) then k end) over (partition by table_name, source) as passed from k)
select table_name, source, unit, width::int as width, bin, ended, at_risk, near_ended, near_at_risk, hazard::double as hazard, around::double as around
from d where k <= passed and hazard >= 4.0 * around and ended >= 4""",
}
