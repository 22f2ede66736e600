"""Column builders for topics, issues and feedback: all run inside the JVM, no Python in the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import rules as R


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict[str, str], key: Column, default: Column) -> Column:
    """The value of ``key`` in a literal map; ``default`` for a missing or null key."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.when(key.isNotNull(), F.element_at(pairs, key)), default)


def classified(title: str, category_id: str | Column, rules: R.TopicRules | None = None) -> Column:
    """Struct (topic_type, type_confidence) of a title, a column's name, in a category.

    A category may fix the type. Otherwise each type scores ``points`` per pattern found in the lowered title, a
    category may add points, and the highest score wins; of equal scores the type listed first, but a type that
    has only a category's points stands behind those with a pattern. Nothing found is the fallback with low confidence.
    A null title counts as empty, a null category as none.
    """
    rules = rules or R.TopicRules()
    # so many patterns would outgrow a generated method; within a lambda they are evaluated one by one, each compiled once. As text they
    # reach the JVM in one call instead of thousands
    points = ", ".join(" + ".join(f"if(t rlike {_quoted(f'(?d){p}')}, {rules.points}, 0)" for p in patterns) for patterns in rules.patterns.values())
    hits = F.expr(f"transform(array(lower(coalesce(`{title}`, ''))), t -> array({points}))")
    category = _col(category_id)
    return F.transform(hits, lambda h: _chosen(h, category, rules)).getItem(0)


def _quoted(text: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chosen(hits: Column, category: Column, rules: R.TopicRules) -> Column:
    """Type and confidence from the points of each type's patterns."""
    candidates = []
    for i, kind in enumerate(rules.patterns):
        found, extra, late = hits.getItem(i), F.lit(0), F.lit(i)
        for c, points in rules.bonuses.items():
            if kind in points:
                extra = F.when(category == c, points[kind]).otherwise(extra)
                late = F.when((category == c) & (found == 0), len(rules.patterns) + list(points).index(kind)).otherwise(late)
        candidates.append(F.struct((found + extra).alias("score"), (-late).alias("first"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*candidates))
    score = best.getField("score")
    confidence = F.when(score >= 3, "high").when(score >= 2, "medium").otherwise("low")
    both = lambda kind, sure: F.struct(kind.alias("topic_type"), sure.alias("type_confidence"))
    out = F.when(score > 0, both(best.getField("kind"), confidence)).otherwise(both(F.lit(rules.fallback), F.lit("low")))
    for c, kind in rules.overrides.items():
        out = F.when(category == c, both(F.lit(kind), F.lit("high"))).otherwise(out)
    return out


def contained(text: Column, words: tuple[str, ...]) -> Column:
    """How many of ``words`` the text contains, anywhere."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def sentiment(text: str | Column, vendor: str | None = None) -> Column:
    """positive, negative, mixed or neutral by the keywords in the lowered text; null counts as empty."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    pos, neg = any_of(R.positive_words(vendor)), any_of(R.NEGATIVE)
    return F.when(pos & neg, "mixed").when(pos, "positive").when(neg, "negative").otherwise("neutral")


def simple_language(text: str | Column) -> Column:
    """unknown if empty or null, zh if over three tenths are Chinese characters, de with two German words, else en."""
    t = F.coalesce(_col(text), F.lit(""))
    chinese = F.regexp_count(t, F.lit("[\\u4e00-\\u9fff]")) / F.greatest(F.length(t), F.lit(1))
    return F.when(t == "", "unknown").when(chinese > 0.3, "zh").when(contained(F.lower(t), R.GERMAN) >= 2, "de").otherwise("en")


def _n(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def issue_engagement(views: str | Column, replies: str | Column, likes: str | Column) -> Column:
    """views / 100 + 2 replies + 3 likes, rounded half to even to one place; null counts as 0."""
    return F.bround(_n(views) / 100 + _n(replies) * 2 + _n(likes) * 3, 1)


def raw_engagement(views: str | Column, replies: str | Column, likes: str | Column) -> Column:
    """views / 50 + 3 replies + 2 likes, not rounded; null counts as 0."""
    return _n(views) / 50 + _n(replies) * 3 + _n(likes) * 2


def resolution(accepted: str | Column, closed: str | Column, official: str | Column, topic_type: str | Column) -> Column:
    """The status of a topic, the first rule that holds; null flags count as false."""
    yes = lambda c: F.coalesce(_col(c), F.lit(False))
    asked = F.coalesce(_col(topic_type).isin(*R.ISSUE_TYPES), F.lit(False))
    return F.when(yes(accepted), R.SOLVED).when(yes(closed), R.CLOSED).when(asked & yes(official), R.ANSWERED).when(asked, R.UNANSWERED).otherwise(R.NOT_APPLICABLE)


def feedback_type(topic_type: str | Column, themes: str | Column) -> Column:
    """The feedback type of a topic type; a comparison needs a comparing theme, else it shares information."""
    mapped = lookup(R.FEEDBACK_TYPES, _col(topic_type), F.lit("info_sharing"))
    compares = F.coalesce(F.arrays_overlap(_col(themes), F.array(*map(F.lit, R.COMPARISON_THEMES))), F.lit(False))
    return F.when((mapped == "comparison") & ~compares, "info_sharing").otherwise(mapped)


def error_codes(text: Column) -> Column:
    """All error codes in a text, in order, repeats kept; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(R.ERROR_CODE), 0), F.array().cast("array<string>"))


def versions(text: Column) -> Column:
    """All version numbers in a text, in order, repeats kept; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(R.VERSION), 0), F.array().cast("array<string>"))


def cut(text: str | Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(_col(text), 1, n)


def joined(items: str | Column, default: str) -> Column:
    """Items with commas between; ``default`` for a null or empty array."""
    return F.when(F.coalesce(F.size(_col(items)), F.lit(-1)) > 0, F.array_join(_col(items), ", ")).otherwise(default)


def thousands(n: str | Column) -> Column:
    """A whole number with commas."""
    return F.format_number(_col(n), 0)


def bar(percent: Column) -> Column:
    """A bar of one block per two percent."""
    return F.repeat(F.lit("█"), (percent / 2).cast("int"))


def padded(n: str | Column, width: int) -> Column:
    """A number right-aligned in ``width``, wider if it needs to be."""
    s = _col(n).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, " ")).otherwise(s)
