"""Text functions as Columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token separators, and word lists of the classifiers below.
SEPARATORS = "[\\s,./|:;()\\[\\]{}'\"!?+-]+"
QUALITY_HIGH = ["compare", "比較", "pricing", "官網"]
QUALITY_MID = ["forum", "討論", "review", "評測"]
LABELS = [
    ("pricing", ["pricing", "price", "plan", "費用"]),
    ("docs", ["docs", "guide", "reference"]),
    ("reviews", ["review", "評測", "評價"]),
    ("discussion", ["forum", "discussion", "討論"]),
    ("articles", ["blog", "news", "article"]),
]
CLAIMS = [
    ("free_available", ["free", "免費", "trial", "試用"]),
    ("paid_required", ["paid", "pricing", "price", "subscription", "付費", "收費", "定價"]),
    ("positive_sentiment", ["positive", "recommended", "best", "推薦", "好評"]),
    ("negative_sentiment", ["negative", "complaint", "issue", "problem", "負評", "抱怨", "災情"]),
    ("official_signal", ["official", "announcement", "release", "公告", "官方"]),
    ("deprecation_signal", ["deprecated", "cancelled", "retired", "停止", "取消"]),
]


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case tokens of at least ``least`` characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: F.length(t) >= least)


def normalized(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_thin(text: Column) -> Column:
    return (F.length(normalized(text)) < 10) | (F.size(tokens(text)) < 3)


def overlap_score(topic_tokens: Column, text_tokens: Column) -> Column:
    """0.2 if either side is empty, else up to 1 by the share of topic tokens found."""
    share = F.size(F.array_intersect(topic_tokens, text_tokens)) / F.greatest(F.size(topic_tokens), F.lit(1))
    empty = (F.size(topic_tokens) == 0) | (F.size(text_tokens) == 0)
    return F.when(empty, F.lit(0.2)).otherwise(F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.8) * share))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def source_quality(text: Column) -> Column:
    t = F.lower(text)
    return F.when(contains_any(t, QUALITY_HIGH), 0.85).when(contains_any(t, QUALITY_MID), 0.7).otherwise(0.6)


def label(text: Column) -> Column:
    t, out = F.lower(text), None
    for name, words in LABELS:
        out = F.when(contains_any(t, words), name) if out is None else out.when(contains_any(t, words), name)
    return out.otherwise("general")


def claims(text: Column) -> Column:
    t = F.lower(text)
    return F.array_compact(F.array(*[F.when(contains_any(t, words), F.lit(name)) for name, words in CLAIMS]))


def snippet(text: Column, fallback: Column, n: int = 220) -> Column:
    return F.substring(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.trim(fallback), F.lit("")), 1, n)
