"""Queries of the forum pipeline on the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import columns as C
from feedloom.functions import rules as R
from feedloom.operators import ranking
from feedloom.operators import relational as rel
from feedloom.plans import report, topics
from feedloom.session import read_table, written

RULES = R.FORUM_RULES


def _raw(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "raw_topic")


def _topics(s: SparkSession, d: str) -> DataFrame:
    return topics.topics(_raw(s, d), read_table(s, d, "category"), read_table(s, d, "official"), RULES)


def _summaries(s: SparkSession, d: str) -> DataFrame:
    return topics.summaries(read_table(s, d, "issue_list"))


def _issues(s: SparkSession, d: str) -> DataFrame:
    return topics.issues(_topics(s, d), _summaries(s, d))


def _features(s: SparkSession, d: str) -> DataFrame:
    return topics.features(_topics(s, d), _summaries(s, d))


def _unified(s: SparkSession, d: str) -> DataFrame:
    t, summary = written(_topics(s, d), "topics"), written(_summaries(s, d), "summaries")
    return topics.unified(t, summary, topics.issues(t, summary))


def _first(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Deduplicated topics with just these columns."""
    return topics.deduplicated(_raw(s, d).select("topic_id", "ord", *columns))


def _texts(df: DataFrame) -> DataFrame:
    """Without ``ord``, arrays as text with commas between."""
    return df.select(*[F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes if c != "ord"])


def dedupe_keep_first(s: SparkSession, d: str) -> DataFrame:
    """The first raw row of each topic."""
    return _first(s, d, "title", "views").select("topic_id", "ord", "title", "views")


def enrich_topics(s: SparkSession, d: str) -> DataFrame:
    """Topics with category name, url, timestamps and posts."""
    return topics.enriched(_raw(s, d), read_table(s, d, "category")).select("topic_id", "title", "category_name", "created_at", "posts_count", "url")


def zero_count_dimension(s: SparkSession, d: str) -> DataFrame:
    """Topics of every category, also of those without any."""
    n = rel.counts_of_all(read_table(s, d, "category"), _first(s, d, "category_id"), "category_id")
    return n.select("category_id", "category_name", "n")


def membership_flag(s: SparkSession, d: str) -> DataFrame:
    """Topics with or without an official response."""
    f = rel.flagged(_first(s, d), read_table(s, d, "official"), "topic_id", "has_official_response")
    return f.select("topic_id", "has_official_response", F.col("has_official_response").cast("bigint").alias("official_response_count"))


def fallback_text(s: SparkSession, d: str) -> DataFrame:
    """Topics with their summary, else their title: the text's first 2000 characters and its whole length."""
    t = rel.left_lookup(_first(s, d, "title"), _summaries(s, d), "topic_id", "summary", F.coalesce("title", F.lit("")), "summary", once=True)
    return t.select("topic_id", C.cut("summary", 2000).alias("text"), F.length("summary").cast("bigint").alias("text_length"))


def classify_rules(s: SparkSession, d: str) -> DataFrame:
    """Every topic's type and confidence by the pattern rules."""
    return _topics(s, d).select("topic_id", "topic_type", "type_confidence")


def category_bonus_tie(s: SparkSession, d: str) -> DataFrame:
    """All titles classified as if in the category that adds points, where ties depend on order."""
    bonus = next(iter(RULES.bonuses))
    t = _first(s, d, "title").withColumn("_c", C.classified("title", F.lit(bonus), RULES))
    return t.select("topic_id", "_c.topic_type", "_c.type_confidence")


def resolution_case(s: SparkSession, d: str) -> DataFrame:
    """Every topic's resolution status."""
    return _topics(s, d).select("topic_id", "resolution_status")


def resolution_distribution(s: SparkSession, d: str) -> DataFrame:
    """Topics by resolution status, most frequent first; ties by first encounter."""
    return report.resolution_distribution(_topics(s, d)).select("place", "resolution_status", "n", "pct")


def issue_rows(s: SparkSession, d: str) -> DataFrame:
    """Issues with score and extracted codes and versions."""
    i = _issues(s, d)
    return i.select("topic_id", "title", "category", "topic_type", "engagement_score", "resolution_status", F.array_join("error_codes", ",").alias("error_codes"), F.array_join("versions_mentioned", ",").alias("versions_mentioned"), "problem_description")


def engagement_topk(s: SparkSession, d: str) -> DataFrame:
    """The 20 hottest issues."""
    return report.top(_issues(s, d), topics.issue_order(), 20).select("place", "topic_id", "engagement_score")


def unanswered_topk(s: SparkSession, d: str) -> DataFrame:
    """The 15 hottest issues without an official response."""
    waiting = _issues(s, d).where(F.col("resolution_status").contains(R.UNANSWERED_MARK))
    return report.top(waiting, topics.issue_order(), 15).select("place", "topic_id", "engagement_score")


def theme_rollup(s: SparkSession, d: str) -> DataFrame:
    """Issues, unresolved issues and hottest issue by theme, with the place by count."""
    r = topics.theme_rollup(_issues(s, d))
    return ranking.numbered(r, [F.col("issues").desc(), F.col("first").asc()], "place").select("place", "theme", "issues", "unresolved", "hot_title")


def inverted_index(s: SparkSession, d: str) -> DataFrame:
    """Error codes in order, with mentions and the hottest issue that mentions them."""
    return ranking.numbered(report.error_index(_issues(s, d)), [F.col("code").asc()], "place").select("place", "code", "mentions", "title", "status")


def listed_code_index(s: SparkSession, d: str) -> DataFrame:
    """The delivered error codes of issue_list, repeats counted, with the hottest record."""
    i = read_table(s, d, "issue_list")
    order = [(-F.coalesce("engagement_score", F.lit(float("-inf")))).alias("s"), F.col("record_id")]
    return rel.inverted_index(i, "error_codes", order, ["topic_id"]).select(F.col("item").alias("code"), F.col("postings").alias("mentions"), F.col("first.topic_id").alias("topic_id"))


def feature_requests(s: SparkSession, d: str) -> DataFrame:
    """Feature requests with support and description."""
    return _features(s, d).select("topic_id", "title", "total_support", "support_signals", "description", "resolution_status")


def feature_topk(s: SparkSession, d: str) -> DataFrame:
    """The 10 feature requests of most support."""
    return report.top(_features(s, d), [F.col("total_support").desc(), F.col("ord").asc()], 10).select("place", "topic_id", "total_support")


def overview_kpis(s: SparkSession, d: str) -> DataFrame:
    """Totals over all topics."""
    return report.kpis(_topics(s, d))


def type_distribution(s: SparkSession, d: str) -> DataFrame:
    """Topics by type, most frequent first, with percentage and bar; ties by first encounter."""
    return report.type_distribution(_topics(s, d)).select("place", "topic_type", "label", "n", "pct", "bar")


def percentile_score(s: SparkSession, d: str) -> DataFrame:
    """Each topic's percentile score of raw engagement."""
    t = _first(s, d, "views", "replies", "likes")
    return ranking.percentile_score(t, C.raw_engagement("views", "replies", "likes"), "engagement_score").select("topic_id", "engagement_score")


def unified_feed(s: SparkSession, d: str) -> DataFrame:
    """The unified feedback feed."""
    return _unified(s, d).select("feedback_id", "text_length", "language", "sentiment", "feedback_type", "engagement_score", F.array_join("error_codes", ",").alias("error_codes"), "resolution_status", "thread_title")


def sentiment_4way(s: SparkSession, d: str) -> DataFrame:
    """Sentiment of every document."""
    return read_table(s, d, "documents").select("doc_id", C.sentiment("text").alias("sentiment"))


def language_detect(s: SparkSession, d: str) -> DataFrame:
    """Documents by delivered label and simply detected language."""
    t = read_table(s, d, "documents").select(F.coalesce("lang", F.lit("-")).alias("lang"), C.simple_language("text").alias("language"))
    return t.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


def feedback_distribution(s: SparkSession, d: str) -> DataFrame:
    """Topics by feedback type and sentiment of the title."""
    t = _topics(s, d).select(C.feedback_type("topic_type", "themes").alias("feedback_type"), C.sentiment("title").alias("sentiment"))
    return t.groupBy("feedback_type", "sentiment").agg(F.count(F.lit(1)).alias("n"))


def theme_top10(s: SparkSession, d: str) -> DataFrame:
    """The ten most frequent tags of all topics; ties by first encounter."""
    c = rel.exploded_counts(_first(s, d, "tags"), "tags", "ord")
    return report.top(c, [F.col("n").desc(), F.col("first").asc()], 10).select("place", F.col("item").alias("theme"), "n")


def full_index(s: SparkSession, d: str) -> DataFrame:
    """Every topic's place by views."""
    return report.full_index(_topics(s, d)).select("place", "topic_id", "views", C.joined(F.slice("themes", 1, 3), "-").alias("themes"), C.thousands("views").alias("views_text"), C.cut("title", 35).alias("title"))


def issue_table(s: SparkSession, d: str) -> DataFrame:
    """Issues with all their columns."""
    return _texts(_issues(s, d))


def feature_table(s: SparkSession, d: str) -> DataFrame:
    """Feature requests with all their columns."""
    return _texts(_features(s, d))


def unified_table(s: SparkSession, d: str) -> DataFrame:
    """The unified feedback feed with all its columns."""
    return _texts(_unified(s, d))


def _written(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Topics, issues, feature requests, each written once, and summaries."""
    t, summary = written(_topics(s, d), "topics"), written(_summaries(s, d), "summaries")
    return t, written(topics.issues(t, summary), "issues"), written(topics.features(t, summary), "features"), summary


def report_lines(s: SparkSession, d: str) -> DataFrame:
    """The Markdown report, a row per line."""
    t, i, f, _ = _written(s, d)
    return report.report_lines(t, i, f, "-", "raw_topic")


def statistics(s: SparkSession, d: str) -> DataFrame:
    """The figures that an export prints, by section and place."""
    t, i, f, summary = _written(s, d)
    return report.statistics(t, i, f, topics.unified(t, summary, i))


QUERIES = {f.__name__: f for f in (
    dedupe_keep_first, enrich_topics, zero_count_dimension, membership_flag, fallback_text, classify_rules, category_bonus_tie, resolution_case,
    resolution_distribution, issue_rows, engagement_topk, unanswered_topk, theme_rollup, inverted_index, listed_code_index, feature_requests, feature_topk,
    overview_kpis, type_distribution, percentile_score, unified_feed, sentiment_4way, language_detect, feedback_distribution, theme_top10, full_index, issue_table, feature_table, unified_table, report_lines, statistics,
)}


# --- the same in SQL ---------------------------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _classified_sql(category: str) -> str:
    """Columns topic_type and type_confidence over a relation with title, as score * 100 - place codes of which the largest wins."""
    kinds = list(RULES.patterns)
    codes, scores = [], []
    for i, k in enumerate(kinds):
        hits = " + ".join(f"(case when regexp_matches(lower(coalesce(title, '')), {_q(p)}) then {RULES.points} else 0 end)" for p in RULES.patterns[k])
        extra = " ".join(f"when {category} = {c} then {pts[k]}" for c, pts in RULES.bonuses.items() if k in pts)
        late = " ".join(f"when {category} = {c} and h{i} = 0 then {len(kinds) + list(pts).index(k)}" for c, pts in RULES.bonuses.items() if k in pts)
        scores.append(f"({hits}) as h{i}")
        codes.append(f"((h{i} + {f'case {extra} else 0 end' if extra else '0'}) * 100 + 50 - {f'case {late} else {i} end' if late else i})")
    best = f"greatest({', '.join(codes)})"
    pick = " ".join(f"when {c} then {_q(k)}" for c, k in [(f"best = c{i}", k) for i, k in enumerate(kinds)])
    fixed = " ".join(f"when {category} = {c} then {_q(k)}" for c, k in RULES.overrides.items())
    inner = f"select *, {', '.join(scores)} from base"
    coded = f"select *, {', '.join(f'{c} as c{i}' for i, c in enumerate(codes))}, {best} as best from ({inner})"
    return (
        f"select * exclude ({', '.join([f'h{i}' for i in range(len(kinds))] + [f'c{i}' for i in range(len(kinds))])}, best), "
        f"case {fixed} when best < 100 then {_q(RULES.fallback)} {pick} end as topic_type, "
        f"case {' '.join(f'when {category} = {c} then {_q("high")}' for c in RULES.overrides)} when best < 100 then 'low' when best // 100 >= 3 then 'high' when best // 100 >= 2 then 'medium' else 'low' end as type_confidence from ({coded})"
    )


_BASE = "base as (select * exclude (rn) from (select *, row_number() over (partition by topic_id order by ord) as rn from raw_topic) where rn = 1)"
_ASKED = "topic_type in ('problem_error', 'question_howto')"
_STATUS = f"case when has_accepted then {_q(R.SOLVED)} when closed then {_q(R.CLOSED)} when {_ASKED} and off then {_q(R.ANSWERED)} when {_ASKED} then {_q(R.UNANSWERED)} else {_q(R.NOT_APPLICABLE)} end"
_SUMS = "sums as (select topic_id, arg_min(problem_description, record_id) as summary from issue_list where problem_description <> '' group by topic_id)"
_TOPICS = f"""with {_BASE}, {_SUMS},
classed as ({_classified_sql('category_id')}),
t0 as (select c.*, coalesce(category_name, 'Unknown') as category_name, exists (select 1 from official o where o.topic_id = c.topic_id) as off,
  {_q(topics.BASE_URL)} || '/t/' || slug || '/' || c.topic_id as url from classed c left join category k on k.category_id = c.category_id),
t as (select t0.*, {_STATUS} as resolution_status, coalesce(summary, '') as summary, coalesce(summary, title, '') as any_text from t0 left join sums using (topic_id)),
iss as (select *, round_even(views / 100 + replies * 2 + likes * 3, 1) as score,
  regexp_extract_all(coalesce(title, '') || ' ' || summary, '{R.ERROR_CODE}') as codes, regexp_extract_all(coalesce(title, '') || ' ' || summary, '{R.VERSION}') as vers from t where {_ASKED})"""


def _has(words: tuple[str, ...], text: str) -> str:
    return "(" + " or ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _sentiment_sql(text: str) -> str:
    p, n = _has(R.POSITIVE, f"lower({text})"), _has(R.NEGATIVE, f"lower({text})")
    return f"case when {p} and {n} then 'mixed' when {p} then 'positive' when {n} then 'negative' else 'neutral' end"


def _language_sql(text: str) -> str:
    german = " + ".join(f"contains(lower({text}), {_q(w)})::int" for w in R.GERMAN)
    chinese = f"len(regexp_extract_all({text}, '[\\x{{4e00}}-\\x{{9fff}}]')) / greatest(length({text}), 1)"
    return f"case when {text} = '' then 'unknown' when {chinese} > 0.3 then 'zh' when {german} >= 2 then 'de' else 'en' end"


_FEEDBACK = (
    "case "
    + " ".join(f"when topic_type = {_q(a)} then " + (f"case when list_has_any(tags, [{', '.join(map(_q, R.COMPARISON_THEMES))}]) then 'comparison' else 'info_sharing' end" if b == "comparison" else _q(b)) for a, b in R.FEEDBACK_TYPES.items())
    + " else 'info_sharing' end"
)
_LABEL = "case " + " ".join(f"when topic_type = {_q(a)} then {_q(b)}" for a, b in R.LABELS.items()) + " end"
_SCORE = "round_even((rank() over (order by coalesce(views, 0) / 50 + coalesce(replies, 0) * 3 + coalesce(likes, 0) * 2) - 1) / count(*) over () * 10, 1)"
_MARK = _q(R.UNANSWERED_MARK)
_ROLL = f"""e as (select theme, score, ord, pos, title, resolution_status from (select *, case when len(tags) > 0 then tags else ['uncategorized'] end as th from iss),
  lateral (select unnest(th) as theme, generate_subscripts(th, 1) as pos)),
r as (select theme, count(*) as issues, count(*) filter (where contains(resolution_status, {_MARK})) as unresolved, min({{'s': -score, 'o': ord, 'p': pos, 't': title}}) as f from e group by theme)"""
_FORMATTED = "case when views < 0 then '-' else '' end || format('{:,}', abs(views))"

_JOINED = "case when len({0}) > 0 then array_to_string({0}, ', ') else {1} end"
_TAGS = "array_to_string(tags, ',') as themes"
_STAMP = "date_str || 'T00:00:00Z'"
_ANY = "(coalesce(t.title, '') || ' ' || t.any_text)"


def _said(section: int, *lines: str) -> str:
    """Fixed lines before those of a section."""
    return " union all ".join(f"select {section} as section, {i - len(lines)}::bigint as line, {_q(x)} as text" for i, x in enumerate(lines))


def _commas(n: str) -> str:
    return f"(case when {n} < 0 then '-' else '' end || format('{{:,}}', abs({n})))"


_KPIS = [("总主题帖", "count(*)::varchar"), ("总帖子数（含回复，估算）", "sum(replies + 1)::bigint::varchar"), ("总浏览量（估算）", _commas("sum(views)::bigint"))] + [
    (name, f"count(*) filter (where {condition})::varchar")
    for name, condition in (("问题/报错帖", "topic_type = 'problem_error'"), ("疑问/求助帖", "topic_type = 'question_howto'"), ("功能建议帖", "topic_type = 'feature_request'"), ("有官方回应", "off"), ("暂无官方回应", f"contains(resolution_status, {_MARK})"))
]
_REPORT = f"""{_TOPICS}, {_ROLL},
kinds as (select topic_type, count(*) as n, min(ord) as o, count(*) / (select count(*) from t) * 100 as pct from t group by topic_type),
themes as (select row_number() over (order by issues desc, f['s'], f['o'], f['p']) as place, theme, issues, unresolved, f['t'] as hot, f['o'] as hot_ord from r),
hot as (select *, row_number() over (order by score desc, ord) as place from iss),
waiting as (select *, row_number() over (order by score desc, ord) as place from iss where contains(resolution_status, {_MARK})),
wanted as (select *, row_number() over (order by likes desc, ord) as place from t where topic_type = 'feature_request'),
code_rows as (select code, score, ord, pos, title, url, resolution_status from (select code, score, ord, title, url, resolution_status, pos from iss, lateral (select unnest(codes) as code, generate_subscripts(codes, 1) as pos))),
code_index as (select code, count(*) as mentions, min({{'s': -score, 'o': ord, 'p': pos, 't': title, 'u': url, 'r': resolution_status}}) as f, row_number() over (order by code) as place from code_rows group by code),
by_views as (select *, row_number() over (order by views desc, ord) as place from t)
{_said(0, "# 用户问题与反馈分析报告" + chr(10), "**生成时间**: -", "**数据来源**: raw_topic")}
union all {_said(1, "## 1. 数据概览" + chr(10), "| 指标 | 数值 |", "|---|---|")}
union all {" union all ".join(f"select 1, {i}, '| {name} | ' || {value} || ' |' from t" for i, (name, value) in enumerate(_KPIS))}
union all {_said(2, "## 2. 帖子类型分布" + chr(10))}
union all select 2, row_number() over (order by n desc, o), '- ' || {_LABEL} || ': ' || n || ' (' || round_even(pct, 0)::int || '%) ' || repeat('█', floor(pct / 2)::int) from kinds
union all {_said(3, "## 3. 高频问题主题（按问题数量排序）" + chr(10), "| 排名 | 主题 | 问题数 | 未回应 | 高热帖 |", "|---|---|---|---|---|")}
union all select 3, place, '| ' || place || ' | ' || theme || ' | ' || issues || ' | ' || unresolved || ' | [' || left(hot, 30) || '...](' || (select url from t where t.ord = hot_ord) || ') |' from themes where place <= 15
union all {_said(4, "## 4. 热门问题 Top 20（按热度排序）" + chr(10), "| # | 类型 | 标题 | 浏览 | 回复 | 状态 | 官方 | 链接 |", "|---|---|---|---|---|---|---|---|")}
union all select 4, place, '| ' || place || ' | ' || case when topic_type = 'problem_error' then '🔴' else '🟡' end || ' | ' || left(title, 40) || ' | ' || {_commas("views")} || ' | ' || replies || ' | ' || left(resolution_status, 5) || ' | ' || case when off then '✅' else '❌' end || ' | [→](' || url || ') |' from hot where place <= 20
union all select 5, -2, '## 5. 暂无官方回应的问题（' || count(*) || ' 个）' || chr(10) from waiting
union all select 5, -1, '按热度排序，以下问题可能需要优先关注：' || chr(10)
union all select 5, place, '### ' || place || '. ' || title || chr(10) || chr(10) || '- **链接**: ' || url || chr(10) || '- **浏览/回复**: ' || {_commas("views")} || ' / ' || replies || chr(10) || '- **主题**: ' || {_JOINED.format("tags", "'未分类'")} || chr(10)
  || case when summary <> '' then '- **问题摘要**: ' || left(summary, 300) || '...' || chr(10) else '' end from waiting where place <= 15
union all {_said(6, "## 6. 用户功能需求/建议 Top 10" + chr(10))}
union all select 6, place, '### ' || place || '. ' || title || ' ' || case when off then '（官方已回应）' else '' end || chr(10) || chr(10) || '- **链接**: ' || url || chr(10) || '- **支持度**: ' || likes || '（' || likes || ' 赞）' || chr(10) || '- **描述**: ' || left(summary, 200) || '...' || chr(10) from wanted where place <= 10
union all select 7, -3, '## 7. 已知错误码索引（' || n || ' 个）' || chr(10) from (select count(*) as n from code_index) where n > 0
union all select 7, line, text from ({_said(7, "| 错误码 | 相关帖子数 | 状态 | 最相关帖 |", "|---|---|---|---|")}) where (select count(*) from code_index) > 0
union all select 7, place, '| `' || code || '` | ' || mentions || ' | ' || left(f['r'], 5) || ' | [' || left(f['t'], 35) || '...](' || f['u'] || ') |' from code_index
union all {_said(8, "## 8. 全部主题索引" + chr(10), "| # | 类型 | 标题 | 板块 | 浏览 | 回复 | 状态 | 主题标签 |", "|---|---|---|---|---|---|---|---|")}
union all select 8, place, '| ' || place || ' | ' || left({_LABEL}, 2) || ' | [' || left(title, 35) || '](' || url || ') | ' || left(category_name, 15) || ' | ' || {_commas("views")} || ' | ' || replies || ' | ' || left(resolution_status, 5) || ' | ' || {_JOINED.format("tags[1:3]", "'-'")} || ' |' from by_views"""
_UNIFIED = f"""u as (select t.*, {_language_sql(_ANY)} as language, {_sentiment_sql(_ANY)} as sentiment, {_FEEDBACK.replace('topic_type', 't.topic_type').replace('tags', 't.tags')} as feedback_type,
  round_even((rank() over (order by t.views / 50 + t.replies * 3 + t.likes * 2) - 1) / count(*) over () * 10, 1) as engagement, coalesce(array_to_string(codes, ','), '') as error_codes from t left join iss on iss.topic_id = t.topic_id)"""


def _shares_sql(section: str, label: str, table: str) -> str:
    return f"select {_q(section)} as section, row_number() over (order by count(*) desc, min(ord)) as place, {label} as label, count(*) as n, count(*) / (select count(*) from {table}) * 100 as pct from {table} group by {label}"


ORACLE = {
    "issue_table": f"""{_TOPICS} select topic_id, title, url, category_name as category, topic_type, {_LABEL} as topic_type_label, {_TAGS}, {_STAMP} as created_at, {_STAMP} as last_active, views, replies as reply_count, likes as like_count,
score as engagement_score, resolution_status, off as has_official_response, '' as official_responders, array_to_string(codes, ',') as error_codes, array_to_string(vers, ',') as versions_mentioned, left(summary, 1000) as problem_description, '' as author, '' as top_solutions from iss""",
    "feature_table": f"""{_TOPICS} select topic_id, title, url, {_TAGS}, {_STAMP} as created_at, views, replies as reply_count, likes as like_count, 0::bigint as support_signals, likes as total_support, left(summary, 500) as description,
off as has_official_response, resolution_status from t where topic_type = 'feature_request'""",
    "unified_table": f"""{_TOPICS}, {_UNIFIED} select 'forum_topic_' || topic_id as feedback_id, 'forum' as platform, url as source_url, '' as author, {_STAMP} as created_at, left(any_text, 2000) as text, length(any_text) as text_length, language, {_TAGS}, sentiment, feedback_type,
null::varchar as parent_id, false as is_reply, likes as like_count, replies as reply_count, views as view_count, false as is_official, resolution_status, error_codes, title as thread_title, false as has_image, engagement as engagement_score from u""",
    "report_lines": _REPORT,
    "statistics": f"""{_TOPICS}, {_UNIFIED}, {_ROLL},
tag_rows as (select tag, ord, pos from (select tag, ord, pos from t, lateral (select unnest(tags) as tag, generate_subscripts(tags, 1) as pos))),
tag_counts as (select tag, count(*) as n, min({{'o': ord, 'p': pos}}) as f from tag_rows group by tag)
select * from (
select 'outputs' as section, place, label, n, null::double as pct from (select 1 as place, 'topics' as label, count(*) as n from t union all select 2, 'issues', count(*) from iss union all select 3, 'feature requests', count(*) from t where topic_type = 'feature_request' union all select 4, 'feedback items', count(*) from u)
union all {_shares_sql("topic types", _LABEL, "t")}
union all {_shares_sql("resolution", "resolution_status", "t")}
union all select 'issue themes', row_number() over (order by issues desc, f['s'], f['o'], f['p']), theme, issues, null from r qualify row_number() over (order by issues desc, f['s'], f['o'], f['p']) <= 10
union all select 'feature requests', row_number() over (order by likes desc, ord), '[' || lpad(likes::varchar, greatest(3, length(likes::varchar))::int, ' ') || ' support] ' || left(title, 60), likes, null from t where topic_type = 'feature_request' qualify row_number() over (order by likes desc, ord) <= 10
union all {_shares_sql("feedback types", "feedback_type", "u")}
union all select 'themes', row_number() over (order by n desc, f['o'], f['p']), tag, n, null from tag_counts qualify row_number() over (order by n desc, f['o'], f['p']) <= 10
union all {_shares_sql("sentiments", "sentiment", "u")})""",
    "dedupe_keep_first": f"with {_BASE} select topic_id, ord, title, views from base",
    "enrich_topics": f"{_TOPICS} select topic_id, title, category_name, date_str || 'T00:00:00Z' as created_at, replies + 1 as posts_count, url from t",
    "zero_count_dimension": f"with {_BASE} select k.category_id, category_name, count(topic_id) as n from category k left join base b on b.category_id = k.category_id group by all",
    "membership_flag": f"with {_BASE} select topic_id, topic_id in (select topic_id from official) as has_official_response, (topic_id in (select topic_id from official))::bigint as official_response_count from base",
    "fallback_text": f"{_TOPICS} select topic_id, left(any_text, 2000) as text, length(any_text) as text_length from t",
    "classify_rules": f"{_TOPICS} select topic_id, topic_type, type_confidence from t",
    "category_bonus_tie": f"with {_BASE}, c as ({_classified_sql(str(next(iter(RULES.bonuses))))}) select topic_id, topic_type, type_confidence from c",
    "resolution_case": f"{_TOPICS} select topic_id, resolution_status from t",
    "resolution_distribution": f"{_TOPICS} select row_number() over (order by count(*) desc, min(ord)) as place, resolution_status, count(*) as n, count(*) / (select count(*) from t) * 100 as pct from t group by resolution_status",
    "issue_rows": f"{_TOPICS} select topic_id, title, category_name as category, topic_type, score as engagement_score, resolution_status, array_to_string(codes, ',') as error_codes, array_to_string(vers, ',') as versions_mentioned, left(summary, 1000) as problem_description from iss",
    "engagement_topk": f"{_TOPICS} select row_number() over (order by score desc, ord) as place, topic_id, score as engagement_score from iss order by place limit 20",
    "unanswered_topk": f"{_TOPICS} select row_number() over (order by score desc, ord) as place, topic_id, score as engagement_score from iss where contains(resolution_status, {_MARK}) order by place limit 15",
    "theme_rollup": f"{_TOPICS}, {_ROLL} select row_number() over (order by issues desc, f['s'], f['o'], f['p']) as place, theme, issues, unresolved, f['t'] as hot_title from r",
    "inverted_index": f"""{_TOPICS}, e as (select code, score, ord, pos, title, resolution_status from iss, lateral (select unnest(codes) as code, generate_subscripts(codes, 1) as pos)),
g as (select code, count(*) as mentions, min({{'s': -score, 'o': ord, 'p': pos, 't': title, 'r': resolution_status}}) as f from e group by code) select row_number() over (order by code) as place, code, mentions, f['t'] as title, f['r'] as status from g""",
    "listed_code_index": """with e as (select unnest(error_codes) as code, generate_subscripts(error_codes, 1) as pos, -coalesce(engagement_score, '-inf'::double) as s, record_id, topic_id from issue_list),
g as (select code, count(*) as mentions, min({'s': s, 'r': record_id, 'p': pos, 't': topic_id}) as f from e group by code) select code, mentions, f['t'] as topic_id from g""",
    "feature_requests": f"{_TOPICS} select topic_id, title, likes as total_support, 0::bigint as support_signals, left(summary, 500) as description, resolution_status from t where topic_type = 'feature_request'",
    "feature_topk": f"{_TOPICS} select row_number() over (order by likes desc, ord) as place, topic_id, likes as total_support from t where topic_type = 'feature_request' order by place limit 10",
    "overview_kpis": f"{_TOPICS} select count(*) as topics, sum(replies + 1)::bigint as posts, sum(views)::bigint as views, {', '.join(f'count(*) filter (where topic_type = {_q(k)}) as {k}' for k in ('problem_error', 'question_howto', 'feature_request'))}, count(*) filter (where off) as official, count(*) filter (where contains(resolution_status, {_MARK})) as unanswered from t",
    "type_distribution": f"{_TOPICS}, d as (select topic_type, count(*) as n, min(ord) as o, count(*) / (select count(*) from t) * 100 as pct from t group by topic_type) select row_number() over (order by n desc, o) as place, topic_type, {_LABEL} as label, n, pct, repeat('█', floor(pct / 2)::int) as bar from d",
    "percentile_score": f"with {_BASE} select topic_id, {_SCORE} as engagement_score from base",
    "unified_feed": f"""{_TOPICS} select 'forum_topic_' || t.topic_id as feedback_id, length(t.any_text) as text_length, {_language_sql("(coalesce(t.title, '') || ' ' || t.any_text)")} as language, {_sentiment_sql("(coalesce(t.title, '') || ' ' || t.any_text)")} as sentiment, {_FEEDBACK.replace('topic_type', 't.topic_type').replace('tags', 't.tags')} as feedback_type,
round_even((rank() over (order by t.views / 50 + t.replies * 3 + t.likes * 2) - 1) / count(*) over () * 10, 1) as engagement_score, coalesce(array_to_string(codes, ','), '') as error_codes, t.resolution_status, t.title as thread_title from t left join iss on iss.topic_id = t.topic_id""",
    "sentiment_4way": f"select doc_id, {_sentiment_sql('text')} as sentiment from documents",
    "language_detect": f"select coalesce(lang, '-') as lang, {_language_sql('text')} as language, count(*) as n from documents group by all",
    "feedback_distribution": f"{_TOPICS} select {_FEEDBACK} as feedback_type, {_sentiment_sql("coalesce(title, '')")} as sentiment, count(*) as n from t group by all",
    "theme_top10": f"with {_BASE}, e as (select unnest(tags) as theme, generate_subscripts(tags, 1) as pos, ord from base), g as (select theme, count(*) as n, min({{'o': ord, 'p': pos}}) as f from e group by theme) select row_number() over (order by n desc, f['o'], f['p']) as place, theme, n from g order by place limit 10",
    "full_index": f"{_TOPICS} select row_number() over (order by views desc, ord) as place, topic_id, views, case when len(tags) > 0 then array_to_string(list_slice(tags, 1, 3), ', ') else '-' end as themes, {_FORMATTED} as views_text, left(title, 35) as title from t",
}
