"""Insight reports from a category summary, and the whole bundle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import highlight_phrases, is_valid_text, title_label
from ..operators.classify import (
    CRITICAL,
    FEATURES,
    category_examples,
    category_summary,
    classify,
    complaint_cluster,
    critical_alerts,
    negative_reviews,
)
from ..operators.clusters import (
    cluster_coverage,
    complaint_cluster_report,
    critical_user_complaints,
    negative_cluster_report,
    top_cluster_reviews,
)
from ..operators.common import share, top_k
from ..operators.grouped import group_key_themes, group_text_clusters, group_topics
from ..operators.phrases import document_phrases
from ..operators.sentiment import score_sentiment, sentiment_summary, sentiment_trends
from ..operators.themes import critical_theme_phrases, critical_themes, tech_summary
from ..rules import DEFAULT_RULES
from ..rules.advice import PRIORITY_ORDER, RECOMMENDATIONS, URGENCY_CAPS, URGENCY_VOLUME, URGENCY_WEIGHTS
from ..schema import BY_APP
from ..session import materialized
from .statistics import rating_distribution, review_statistics, top_helpful


def priority_issues(
    summary: DataFrame, group: str, by: Sequence[str] = BY_APP, k: int = 5
) -> DataFrame:
    """Issues of a report section by 0.4 x share + 0.6 x severity; requests by 0.6 x share
    + 0.4 x priority (A4, A5)."""
    weights = (0.6, 0.4) if group == FEATURES else (0.4, 0.6)
    scored = summary.where(F.col("grp") == group).select(
        *by, "issue", title_label("issue").alias("title"), "count", "percentage", "avg_score", "level",
        (F.col("percentage") * F.lit(weights[0]) + F.col("avg_score") * F.lit(weights[1])).alias("combined_score"),
    )
    return top_k(scored, by, [F.desc("combined_score"), F.asc("issue")], k, rank="rank")


def feature_request_examples(
    reviews: DataFrame, rules=DEFAULT_RULES, by: Sequence[str] = BY_APP, k: int = 3
) -> DataFrame:
    """The newest requests of each feature with phrases around their terms (A5)."""
    feature_rules = tuple(rule for rule in rules if rule.id == FEATURES)
    wanted = reviews.select(*dict.fromkeys([*by, "review_id", "rating", "at", "review"]))
    requests = classify(wanted, feature_rules).where(F.col("grp") == FEATURES)
    best = top_k(requests, [*by, "issue"], [F.desc("at"), F.asc("review_id")], k, rank="rank")
    terms = F.lit(None).cast("array<string>")
    for rule in feature_rules:
        for name, items in rule.subcategories.items():
            listed = F.array(*[F.lit(item) for item in items])
            terms = F.when(F.col("issue") == name, listed).otherwise(terms)
    return best.select(
        *by, "issue", "rank", "review_id", "rating", "at", "keyword",
        highlight_phrases("review", "keyword", terms).alias("highlighted_phrases"),
    )


def critical_complaint_summary(summary: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Critical complaints, their share, and whether they exceed 5% of the reviews.

    Every group of the summary has a row, also one without critical complaints.
    """
    critical = F.when(F.col("grp") == CRITICAL, F.col("count"))
    totals = summary.groupBy(*by).agg(
        F.coalesce(F.sum(critical), F.lit(0)).alias("total_count"),
        F.max("total_reviews").alias("total_reviews"),
    )
    return totals.withColumns({
        "percentage_of_reviews": share(F.col("total_count"), F.col("total_reviews")),
        "requires_immediate_attention": F.col("total_count") > F.col("total_reviews") * 0.05,
    })


def recommendations(summary: DataFrame, by: Sequence[str] = BY_APP, k: int = 10) -> DataFrame:
    """Recommendations whose issue is frequent enough, most urgent first.

    Reads a category summary at subcategory level.
    """
    names = ("grp", "issue", "min_count", "category", "action", "priority", "impact", "timeline", "severity")
    order = {name: i for i, name in enumerate(PRIORITY_ORDER)}
    advice = F.coalesce(*[
        F.when(
            (F.col("grp") == row[0]) & (F.col("issue") == row[1]) & (F.col("count") >= row[2]),
            F.struct(
                *[F.lit(value).alias(name) for name, value in zip(names[3:], row[3:], strict=True)],
                F.lit(order[row[5]]).alias("order"),
            ),
        )
        for row in RECOMMENDATIONS
    ])
    matched = summary.withColumn("__advice", advice).where(F.col("__advice").isNotNull())
    best = top_k(
        matched, by, [F.asc("__advice.order"), F.desc("count"), F.asc("issue")], k, rank="rank"
    )
    users = F.when(F.col("grp") == FEATURES, "requests").otherwise("reports")
    return best.select(
        *by, "rank", "issue", "__advice.category", "__advice.action", "__advice.priority",
        "__advice.impact", "__advice.timeline", "__advice.severity", "count",
        F.format_string("%d %s (%.1f%%)", F.col("count"), users, F.col("percentage")).alias("affected_users"),
    )


def _urgency_weight(group: str) -> Column:
    weight = F.lit(1.0)
    for issue, value in URGENCY_WEIGHTS[group].items():
        weight = F.when(F.col("issue") == issue, F.lit(value)).otherwise(weight)
    return weight


def urgency_score(summary: DataFrame, sentiments: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Urgency of 0-100 from negative share, weighted complaints and volume.

    Reads a subcategory-level category summary and a sentiment summary.
    """

    def points(group):
        # Counts are weighted, not shares: the sum is the same in any order.
        return F.coalesce(
            F.sum(F.when(F.col("grp") == group, F.col("count") * _urgency_weight(group)).cast("decimal(30,2)"))
            .cast("double"),
            F.lit(0.0),
        )

    weighted = summary.groupBy(*by).agg(
        points(CRITICAL).alias("__critical"), points("tech_issues").alias("__tech")
    )
    joined = sentiments.select(*by, "total_reviews", "negative_count").join(weighted, list(by), "left")
    total = F.col("total_reviews")

    def capped(value, part):
        return F.least(F.lit(float(URGENCY_CAPS[part])), share(F.coalesce(value, F.lit(0.0)), total))

    volume = None
    for more_than, worth in URGENCY_VOLUME:
        volume = F.when(total > more_than, worth) if volume is None else volume.when(total > more_than, worth)
    score = (
        capped(F.col("negative_count").cast("double"), "sentiment")
        + capped(F.col("__critical"), CRITICAL) + capped(F.col("__tech"), "tech_issues") + volume.otherwise(2)
    )
    return joined.select(*by, "total_reviews", F.least(F.lit(100), F.floor(score)).cast("int").alias("urgency_score"))


def executive_summary(
    urgency: DataFrame, critical: DataFrame, alerts: DataFrame, tech: DataFrame, ux: DataFrame,
    features: DataFrame, by: Sequence[str] = BY_APP,
) -> DataFrame:
    """Health, main concern, top opportunity and alert count per group.

    Reads the reports above; each holds a handful of rows per group.
    """
    keys = list(by)
    overall_first = F.when(F.col("type") == "overall_critical", 0).otherwise(1)
    alert_rows = alerts.groupBy(*by).agg(
        F.count("*").alias("critical_alerts_count"),
        F.min_by("message", F.struct(overall_first, -F.col("count"), F.col("type"))).alias("__alert"),
    )

    def first(report, name, unit):
        text = F.format_string(f"%s (%d {unit})", "title", "count")
        return report.where(F.col("rank") == 1).select(*by, text.alias(name))

    joined = (
        urgency.join(critical.select(*by, "percentage_of_reviews"), keys, "left")
        .join(alert_rows, keys, "left")
        .join(first(tech, "__tech", "reports"), keys, "left")
        .join(first(ux, "__ux", "reports"), keys, "left")
        .join(first(features, "__feature", "requests"), keys, "left")
    )
    score = F.col("urgency_score")
    pct = F.round(F.coalesce(F.col("percentage_of_reviews"), F.lit(0.0)), 1)
    health = (
        F.when((score >= 70) | (pct > 10), "Critical").when((score >= 50) | (pct > 5), "Poor")
        .when((score >= 30) | (pct > 2), "Fair").when(score >= 15, "Good").otherwise("Excellent")
    )
    return joined.select(
        *by, "total_reviews", "urgency_score",
        health.alias("overall_health"),
        health.isin("Critical", "Poor", "Fair").alias("action_required"),
        F.coalesce("__alert", "__tech", "__ux", F.lit("None identified")).alias("main_concern"),
        F.coalesce("__feature", F.lit("None identified")).alias("top_opportunity"),
        F.coalesce("critical_alerts_count", F.lit(0)).alias("critical_alerts_count"),
    )


SECTIONS = ("statistics", "sentiment", "classification", "insights", "clusters", "topics")


def analysis_meta(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """All and valid reviews per group; fewer than three valid ones are too few."""
    counts = reviews.groupBy(*by).agg(
        F.count("*").alias("total_reviews"), F.count_if(is_valid_text("review")).alias("valid_reviews")
    )
    return counts.withColumn("enough", F.col("valid_reviews") >= 3)


def comprehensive_report(
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    rules=DEFAULT_RULES,
    by: Sequence[str] = BY_APP,
    include: Iterable[str] = SECTIONS,
) -> dict[str, DataFrame]:
    """All report sections by name (A10); sections left out cost nothing.

    Reviews are scored once into a table in the shared folder that all sections read, and
    the category summaries, which feed several sections, are written once too. Topics and text
    clusters are models of each group for itself; groups of too few texts have none.
    """
    include = set(include)
    unknown = include - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}; known: {SECTIONS}")
    report: dict[str, DataFrame] = {"meta": analysis_meta(reviews, by)}
    scored = materialized(score_sentiment(reviews, lexicon))
    reviews = scored.select(*reviews.columns)
    sentiments = sentiment_summary(scored, by)
    if include & {"classification", "insights"}:
        by_issue = materialized(category_summary(reviews, rules, by))
        alerts = critical_alerts(reviews, rules, by, summary=by_issue)
    if "statistics" in include:
        report["review_statistics"] = review_statistics(reviews, by)
        report["rating_distribution"] = rating_distribution(reviews, by)
        report["top_helpful"] = top_helpful(reviews, by)
    if "sentiment" in include:
        report["sentiment_summary"] = sentiments
        report["sentiment_trends"] = sentiment_trends(sentiments, by)
    if "classification" in include:
        report["category_summary"] = by_issue
        report["category_examples"] = category_examples(reviews, rules, by)
        report["critical_alerts"] = alerts
    if "insights" in include:
        ux = priority_issues(by_issue, "ux_issues", by)
        tech = priority_issues(by_issue, "tech_issues", by)
        features = priority_issues(by_issue, FEATURES, by)
        critical = critical_complaint_summary(by_issue, by)
        by_sub = materialized(category_summary(reviews, rules, by, level="subcategory"))
        urgency = urgency_score(by_sub, sentiments, by)
        themes = critical_themes(reviews, by)
        report |= {
            "priority_ux_issues": ux,
            "priority_tech_issues": tech,
            "top_feature_requests": features,
            "feature_request_examples": feature_request_examples(reviews, rules, by),
            "critical_complaints_summary": critical,
            "recommendations": recommendations(by_sub, by),
            "urgency_score": urgency,
            "summary": executive_summary(urgency, critical, alerts, tech, ux, features, by),
            "critical_themes": themes,
            "critical_theme_phrases": critical_theme_phrases(reviews, by),
            "tech_issues_summary": tech_summary(themes, by),
        }
    if "clusters" in include:
        negatives = negative_reviews(scored, "rating_and_label").withColumn(
            "cluster_id", complaint_cluster("review")
        )
        keys = [*by, "cluster_id"]
        report |= {
            "complaint_clusters": complaint_cluster_report(negatives, by, severity="confidence"),
            "complaint_cluster_reviews": top_cluster_reviews(negatives, by, k=2),
            "negative_clusters": negative_cluster_report(
                negatives, by, phrases=document_phrases(negatives, keys), minimum=3
            ),
            "negative_cluster_reviews": top_cluster_reviews(negatives, by, k=3, size=200, minimum=3),
            "cluster_coverage": cluster_coverage(negatives, by),
            "critical_user_complaints": critical_user_complaints(negative_reviews(scored, "any_signal"), by),
            "text_clusters": complaint_cluster_report(
                group_text_clusters(negative_reviews(scored, "rating_and_label"), by, 20, 2, 10, 5, 1000), by,
                severity="confidence",
            ),
        }
    if "topics" in include:
        report["key_themes"] = group_key_themes(group_topics(reviews, by)[0], by)
    return report
