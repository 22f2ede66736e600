"""Rule sets as data: title patterns, category effects, keywords and labels. All are parameters of the functions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values, in the order in which ties are settled. A pattern listed twice counts twice.
PATTERNS: dict[str, tuple[str, ...]] = {
    "problem_error": (
        r"error", r"fail", r"issue", r"problem", r"bug", r"can'?t", r"won'?t", r"doesn'?t", r"not working",
        r"stuck", r"crash", r"broken", r"defect", r"0003-\d+", r"struggling", r"costing",
    ),
    "question_howto": (
        r"^how ", r"\?$", r"^can (?:i|we|you|the)", r"^is (?:it|there|this)", r"^does ", r"^what ", r"^why ",
        r"^where ", r"^when ", r"^which ", r"question", r"help", r"anyone", r"configuration",
    ),
    "feature_request": (
        r"request", r"suggestion", r"wish", r"please add", r"would be nice", r"feature", r"need .*support",
        r"should ", r"improvement", r"add .*to", r"s\.a\.m\.m", r"suggestion",
    ),
    "showcase": (
        r"showcase", r"my (?:first|latest|new|mini) ", r"show ?off", r"printed this", r"check.?out", r"collection",
        r"gallery", r"printing the", r"first.*print", r"what did you.*print", r"hyrule", r"airless", r"basketball",
    ),
    "tip_guide": (
        r"tip", r"trick", r"guide", r"tutorial", r"easy way", r"mod(?:ification)?", r"diy", r"calibration guide",
        r"profile", r"eliminate", r"solution for", r"converter", r"tool\]",
    ),
    "official_update": (
        r"official", r"update", r"firmware", r"release note", r"kickstarter update", r"video guide",
        r"support center", r"wiki", r"submit.*ticket", r"recommended", r"manufactured", r"tested", r"about the",
    ),
    "discussion": (r"vs\.?", r"comparison", r"thought", r"opinion", r"experience", r"review", r"druckzeit"),
}

# Fixed values.
LABELS = {
    "problem_error": "🔴 问题/报错",
    "question_howto": "🟡 疑问/求助",
    "feature_request": "🟣 功能需求/建议",
    "showcase": "🟢 作品展示",
    "tip_guide": "🔵 技巧/教程",
    "official_update": "📢 官方更新",
    "discussion": "💬 讨论",
}
FEEDBACK_TYPES = {
    "problem_error": "problem",
    "question_howto": "question",
    "feature_request": "feature_request",
    "showcase": "info_sharing",
    "tip_guide": "info_sharing",
    "official_update": "info_sharing",
    "discussion": "comparison",
}
COMPARISON_THEMES = ("vs_competitor", "price_value")
POSITIVE = (
    "love", "amazing", "excellent", "impressed", "great", "fantastic", "perfect", "recommend", "awesome", "happy",
    "beautiful", "solid", "worth", "best", "thank you",
)
NEGATIVE = (
    "issue", "problem", "bug", "fail", "disappoint", "frustrat", "noise", "loud", "crash", "error", "defect",
    "broken", "expensive", "regret", "return", "terrible", "waste", "can't", "won't", "doesn't", "not working",
    "struggling",
)
GERMAN = ("das", "die", "der", "und", "ist", "ich", "nicht", "ein", "mit", "druckzeit")
ERROR_CODE = r"\d{4}-\d{4}-\d{4}-\d{4}"
VERSION = r"[Vv]?\d+\.\d+\.\d+"
SOLVED, CLOSED, ANSWERED, UNANSWERED, NOT_APPLICABLE = "✅ 已解决（有采纳答案）", "🔒 已关闭", "🟡 官方已回应", "🔴 暂无官方回应", "⚪ 不适用"
UNANSWERED_MARK = "🔴"
ISSUE_TYPES = ("problem_error", "question_howto")


@dataclass(frozen=True)
class TopicRules:
    """Patterns by type, categories that fix the type, points that a category adds, and labels."""

    patterns: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PATTERNS))
    overrides: dict[int, str] = field(default_factory=lambda: {92: "showcase", 91: "official_update"})
    bonuses: dict[int, dict[str, int]] = field(default_factory=lambda: {93: {"problem_error": 3, "question_howto": 1}})
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))
    points: int = 2
    fallback: str = "discussion"


#: The same rules with the categories of the test tables: release notes, show and tell, ideas box, help desk.
FORUM_RULES = replace(TopicRules(), overrides={87: "showcase", 91: "official_update", 95: "feature_request"}, bonuses={11: {"problem_error": 3, "question_howto": 1}})


def positive_words(vendor: str | None = None) -> tuple[str, ...]:
    """The positive keywords; with a vendor's name also thanks addressed to it."""
    return POSITIVE + ((f"thanks {vendor.lower()}",) if vendor else ())
