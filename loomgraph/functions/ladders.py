"""Classification ladders, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step whose bound the value reaches."""
    out = None
    for bound, name in steps:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(rest)


#: Bounds and names.
STRENGTH = [(0.7, "strong"), (0.4, "moderate")]
PRIORITY = [(0.8, "high"), (0.6, "medium")]
RECOMMENDATION = [(0.8, "very_strong"), (0.6, "strong"), (0.4, "moderate")]
CLUSTER_COUNTS = [(8, 2), (16, 3), (32, 4), (64, 5), (100, 6), (128, 7), (256, 8), (512, 9)]


def strength(correlation: Column, steps: list[tuple[float, str]] | None = None) -> Column:
    return ladder(correlation, steps or STRENGTH, "weak")


def priority(score: Column) -> Column:
    return ladder(score, PRIORITY, "low")


def recommendation_strength(score: Column) -> Column:
    return ladder(score, RECOMMENDATION, "weak")


def quality_rating(score: Column) -> Column:
    return F.when(score > 0.7, "excellent").when(score > 0.5, "good").when(score > 0.25, "fair").otherwise("poor")


def optimal_clusters(n: Column) -> Column:
    """How many clusters n neighborhoods are merged into."""
    out = F.when(n <= 2, n)
    for most, k in CLUSTER_COUNTS:
        out = out.when(n <= most, k)
    return out.otherwise(10).cast("long")


def reason(frequency: Column, share: Column) -> Column:
    return (
        F.when(frequency > 20, F.format_string("frequently change together (%d times)", frequency))
        .when(share > 0.8, F.concat(F.lit("strong correlation ("), F.format_string("%.1f", share * 100), F.lit("% confidence)")))
        .otherwise("related through change patterns")
    )


def usage_pattern(correlation: Column, frequency: Column) -> Column:
    return F.when(correlation > 0.8, "tightly_coupled").when(frequency > 10, "frequently_changed").otherwise("occasional")


def common_operation(frequency: Column, confidence: Column) -> Column:
    return F.when((frequency > 10) & (confidence > 0.8), "frequent_and_certain").when(frequency > 10, "frequent").when(confidence > 0.8, "certain").otherwise("none")


def optimal_tasks(path: Column) -> Column:
    p = F.lower(path)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(p, w))
    return (
        F.when(has("test"), "testing,debugging,quality_assurance")
        .when(has("config", ".yaml", ".json", ".toml"), "configuration,setup,deployment")
        .when(has("readme", "doc", ".md"), "documentation,maintenance,onboarding")
        .otherwise("development,refactoring,feature_implementation")
    )
