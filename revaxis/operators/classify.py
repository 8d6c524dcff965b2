"""Issue and feature-request classification by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import priority_level, severity_level
from ..functions.matching import (
    first_label,
    on_text,
    sql_any,
    sql_first,
    sql_let,
    sql_literal,
    sql_struct,
)
from ..functions.text import snippet
from ..rules import DEFAULT_RULES, Category
from ..rules.themes import COMPLAINT_CLUSTERS, GENERAL_COMPLAINTS
from ..rules.words import REQUEST_INDICATORS
from ..schema import BY_APP
from .common import explode_counting_all, share, spread_totals, top_k

FEATURES = "feature_requests"
CRITICAL = "critical_complaints"
# Fixed value: score of a request found only by an indicator word.
INDICATOR_SCORE = 3.0

_TAG_FIELDS = (
    ("category_id", "string"), ("grp", "string"), ("issue", "string"), ("subcategory", "string"),
    ("keyword", "string"), ("multiplier", "double"), ("threshold", "double"), ("indicator", "boolean"),
)


def _tag(rule, issue: str, subcategory: str, keyword: str, indicator: bool = False) -> str:
    values = (
        sql_literal(rule.id), sql_literal(rule.group), issue, subcategory, keyword,
        sql_literal(float(rule.priority_multiplier)), sql_literal(float(rule.alert_threshold)),
        sql_literal(indicator),
    )
    fields = {
        name: f"cast({value} as {kind})" for value, (name, kind) in zip(values, _TAG_FIELDS, strict=True)
    }
    return sql_struct(**fields)


def _first_subcategory(rule) -> str:
    """``(name, term)`` of the first subcategory with a term in the text."""
    kind = "struct<name:string,term:string>"
    found = [
        sql_let(
            "_hit", sql_first("_t", terms),
            f"if(_hit IS NULL, NULL, {sql_struct(name=sql_literal(name), term='_hit')})",
        )
        for name, terms in rule.subcategories.items()
    ]
    return f"coalesce({', '.join(found)}, cast(NULL as {kind}))"


def review_tags(text: str = "review", rules=DEFAULT_RULES) -> Column:
    """All classification tags of a text as an array of structs.

    A category's subcategories are scanned only when one of its keywords is found.
    """

    def of_category(rule):
        if rule.id == FEATURES:
            tag = _tag(
                rule, "coalesce(_sub.name, 'general_requests')", "_sub.name", "coalesce(_sub.term, _keyword)"
            )
        else:
            tag = _tag(rule, sql_literal(rule.id), "_sub.name", "_keyword")
        gated = f"if(_keyword IS NULL, NULL, {sql_let('_sub', _first_subcategory(rule), tag)})"
        return sql_let("_keyword", sql_first("_t", rule.keywords), gated)

    features = next((rule for rule in rules if rule.id == FEATURES), Category(FEATURES, "Feature Requests", ()))
    indicated = _tag(features, "'general_requests'", "NULL", "'general request'", True)
    found = f"array_compact(array({', '.join(of_category(rule) for rule in rules)}))"
    # A request known only by an indicator word counts if no request was found before.
    fallback = (
        f"if(exists(_tags, _x -> _x.grp = '{FEATURES}') OR NOT {sql_any('_t', REQUEST_INDICATORS)}, "
        f"_tags, array_append(_tags, {indicated}))"
    )
    return on_text(text, sql_let("_tags", found, fallback))


def classify(reviews: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """One row per review and matched category, with score and snippet."""
    tagged = reviews.withColumn("tag", F.explode(review_tags("review", rules)))
    text = F.lower(F.col("review"))
    critical = F.col("tag.grp") == CRITICAL
    return tagged.select(
        *reviews.columns,
        *[F.col(f"tag.{name}").alias(name) for name, _ in _TAG_FIELDS],
        _score(F.col("tag.indicator"), F.col("rating"), F.col("tag.multiplier")).alias("score"),
        F.when(critical, snippet(text, 150)).otherwise(snippet(text, 100)).alias("text_snippet"),
        F.when(critical, "CRITICAL").alias("alert_priority"),
    )


def _score(indicator: Column, rating: Column, multiplier: Column) -> Column:
    return F.when(indicator, F.lit(INDICATOR_SCORE)).otherwise((F.lit(6) - rating) * multiplier)


def classification_flags(reviews: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Reviews with the issues found and one flag per report section (C4)."""
    tagged = reviews.withColumn("tags", review_tags("review", rules))

    def in_group(group):
        return F.exists("tags", lambda tag: tag["grp"] == group)

    return tagged.select(
        *reviews.columns,
        F.transform(
            "tags",
            lambda tag: F.when(tag["grp"] == FEATURES, F.concat(F.lit("feature_"), tag["issue"])).otherwise(
                tag["issue"]
            ),
        ).alias("categories_found"),
        in_group("ux_issues").alias("has_ux_issues"),
        in_group(FEATURES).alias("has_feature_requests"),
        in_group(CRITICAL).alias("has_critical_complaints"),
        in_group("tech_issues").alias("has_tech_issues"),
        in_group("other_issues").alias("has_other_issues"),
    )


def category_summary(
    reviews: DataFrame, rules=DEFAULT_RULES, by: Sequence[str] = BY_APP, level: str = "issue"
) -> DataFrame:
    """Count, share, mean and maximum score per group and issue.

    ``level='subcategory'`` splits every category by its first matching subcategory.
    One scan and one shuffle: group totals travel with the tags.
    """
    if level not in ("issue", "subcategory"):
        raise ValueError("level must be 'issue' or 'subcategory'")
    tagged = reviews.select(*by, "rating", review_tags("review", rules).alias("tags"))
    exploded = explode_counting_all(tagged, "tags", "tag")
    issue = F.col("tag.issue")
    if level == "subcategory":
        issue = F.coalesce(F.col("tag.subcategory"), issue)
    base = F.lit(6) - F.col("rating")
    direct = ~F.col("tag.indicator")
    summed = exploded.groupBy(*by, F.col("tag.grp").alias("grp"), issue.alias("issue")).agg(
        F.count("*").alias("count"),
        F.sum(F.when(direct, base)).alias("base_sum"),
        F.max(F.when(direct, base)).alias("base_max"),
        F.count_if("tag.indicator").alias("indicated"),
        F.max("tag.multiplier").alias("multiplier"),
        F.max("tag.threshold").alias("threshold"),
    )
    # Scores are a whole number times a category constant: the whole numbers are summed,
    # so the mean does not depend on the order rows arrive in.
    mean = (
        F.coalesce(F.col("base_sum"), F.lit(0)) * F.col("multiplier")
        + F.col("indicated") * F.lit(INDICATOR_SCORE)
    ) / F.col("count")
    peak = F.greatest(
        F.col("base_max") * F.col("multiplier"), F.when(F.col("indicated") > 0, F.lit(INDICATOR_SCORE))
    )
    spread = spread_totals(summed, by, "issue", {"count": "total_reviews"})
    scored = spread.withColumn("avg_score", mean)
    return scored.select(
        *by, "grp", "issue", "count", "total_reviews",
        share(F.col("count"), F.col("total_reviews")).alias("percentage"),
        "avg_score",
        peak.alias("max_score"),
        F.when(F.col("grp") == FEATURES, priority_level("avg_score"))
        .otherwise(severity_level("avg_score")).alias("level"),
        "threshold",
    )


def category_examples(
    reviews: DataFrame, rules=DEFAULT_RULES, by: Sequence[str] = BY_APP, k: int = 3
) -> DataFrame:
    """The newest ``k`` reviews of each issue with keyword and snippet."""
    wanted = reviews.select(*dict.fromkeys([*by, "review_id", "rating", "at", "review"]))
    rows = classify(wanted, rules).select(
        *by, "grp", "issue", "review_id", "rating", "at", "keyword", "score", "text_snippet"
    )
    return top_k(rows, [*by, "grp", "issue"], [F.desc("at"), F.asc("review_id")], k, rank="rank")


def critical_alerts(
    reviews: DataFrame, rules=DEFAULT_RULES, by: Sequence[str] = BY_APP,
    mode: str = "fixed", level: str = "issue", summary: DataFrame | None = None,
) -> DataFrame:
    """Alerts on frequent critical complaints, plus one overall alert per group.

    ``mode='fixed'`` alerts from 5% of the reviews on, ``'rule'`` from the category's own
    alert threshold on; twice that is HIGH.
    """
    if summary is None:
        summary = category_summary(reviews, rules, by, level)
    critical = summary.where(F.col("grp") == CRITICAL)
    ratio = F.lit(0.05) if mode == "fixed" else F.col("threshold")
    limit = F.greatest(F.lit(1), F.floor(F.col("total_reviews") * ratio))
    each = critical.where(F.col("count") >= limit).select(
        *by, F.col("issue").alias("type"), "count", "percentage",
        F.when(F.col("count") >= limit * 2, "HIGH").otherwise("MEDIUM").alias("alert_level"),
        F.format_string(
            "CRITICAL ALERT: %d reports of %s (%.1f%% of reviews)",
            "count", F.translate("issue", "_", " "), "percentage",
        ).alias("message"),
    )
    overall = (
        critical.groupBy(*by)
        .agg(F.sum("count").alias("count"), F.max("total_reviews").alias("total"))
        .where(F.col("count") > F.col("total") * 0.1)
        .withColumn("percentage", share(F.col("count"), F.col("total")))
        .select(
            *by, F.lit("overall_critical").alias("type"), "count", "percentage",
            F.lit("HIGH").alias("alert_level"),
            F.format_string(
                "HIGH CRITICAL COMPLAINT RATE: %d critical complaints (%.1f%% of reviews)",
                "count", "percentage",
            ).alias("message"),
        )
    )
    return overall.unionByName(each)


NEGATIVE_MODES = ("rating", "rating_and_label", "any_signal", "score_or_rating")


def negative_reviews(reviews: DataFrame, mode: str = "rating") -> DataFrame:
    """Negative subset by one of the known definitions.

    ``rating``: at most 3 stars. ``rating_and_label``: at most 2 stars and a negative
    ``sentiment``. ``any_signal``: at most 2 stars, or a negative ``sentiment``,
    ``compound`` or ``polarity`` below -0.1. ``score_or_rating``: ``severity`` above 0.5
    or at most 2 stars.
    """
    rating = F.col("rating")
    if mode == "rating":
        keep = rating <= 3
    elif mode == "rating_and_label":
        keep = (rating <= 2) & (F.lower("sentiment") == "negative")
    elif mode == "any_signal":
        keep = (
            (rating <= 2) | (F.lower("sentiment") == "negative")
            | (F.col("compound") < -0.1) | (F.col("polarity") < -0.1)
        )
    elif mode == "score_or_rating":
        keep = (F.coalesce(F.col("severity"), F.lit(0.5)) > 0.5) | (rating <= 2)
    else:
        raise ValueError(f"mode must be one of {NEGATIVE_MODES}")
    return reviews.where(keep)


def complaint_cluster(text: str = "review", clusters=COMPLAINT_CLUSTERS) -> Column:
    """Keyword cluster of a complaint; the first cluster with a term wins."""
    return first_label(text, tuple(clusters.items()), GENERAL_COMPLAINTS)
