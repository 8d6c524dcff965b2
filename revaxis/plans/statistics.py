"""Review statistics and dashboard figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators.clusters import criticality
from ..operators.common import share, top_k
from ..schema import BY_APP

STARS = (1, 2, 3, 4, 5)


def review_statistics(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Rating, length and word figures per group (A1)."""
    figures = reviews.select(
        *by, "rating", F.length("review").alias("length"), word_count("review").alias("words")
    )
    return figures.groupBy(*by).agg(
        F.count("*").alias("total_reviews"),
        F.avg("rating").alias("avg_rating"),
        *[F.count_if(F.col("rating") == star).alias(f"stars_{star}") for star in STARS],
        F.avg("length").alias("avg_review_length"),
        F.sum("words").alias("total_words"),
        F.avg("words").alias("avg_words_per_review"),
    )


def rating_distribution(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Count and share of every star rating, zero filled, over all reviews of a group (A2)."""
    counts = reviews.groupBy(*by).agg(
        F.count("*").alias("total_reviews"),
        *[F.count_if(F.col("rating") == star).alias(f"stars_{star}") for star in STARS],
    )
    stars = F.array(*[
        F.struct(F.lit(star).alias("rating"), F.col(f"stars_{star}").alias("count")) for star in STARS
    ])
    rows = counts.select(*by, "total_reviews", F.explode(stars).alias("star"))
    return rows.select(
        *by, "star.rating", "star.count",
        share(F.col("star.count"), F.col("total_reviews")).alias("percentage"),
    )


def top_helpful(reviews: DataFrame, by: Sequence[str] = BY_APP, k: int = 5) -> DataFrame:
    """The ``k`` reviews with most votes among 4-5 stars and among 1-2 stars (A3)."""
    polarity = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") <= 2, "negative")
    sided = reviews.where((F.col("rating") >= 4) | (F.col("rating") <= 2)).withColumn("polarity", polarity)
    return top_k(sided, [*by, "polarity"], [F.desc("thumbs_up"), F.asc("review_id")], k, rank="rank")


def negative_trend(
    reviews: DataFrame, as_of: Column, by: Sequence[str] = BY_APP, windows: Sequence[int] = (14, 60)
) -> DataFrame:
    """Negative reviews of the last days against as many days before.

    The change is a percentage of the previous window; with none before it is 100 if
    there are any now, else 0. The recent window has no upper end.
    """
    negative = F.col("rating") <= 2
    figures = [F.count_if(negative).alias("total_negative")]
    for days in windows:
        recent = as_of - F.make_dt_interval(F.lit(days))
        before = as_of - F.make_dt_interval(F.lit(2 * days))
        figures.append(F.count_if(negative & (F.col("at") >= recent)).alias(f"recent_{days}d"))
        figures.append(
            F.count_if(negative & (F.col("at") >= before) & (F.col("at") < recent)).alias(f"previous_{days}d")
        )
    return trend_changes(reviews.groupBy(*by).agg(*figures), windows)


def trend_changes(counted: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Change and direction from the counts ``recent_<n>d`` and ``previous_<n>d`` of every window."""
    for days in windows:
        now, then = F.col(f"recent_{days}d"), F.col(f"previous_{days}d")
        change = (
            F.when(then > 0, F.try_divide(now - then, then) * 100).when(now > 0, F.lit(100.0))
            .otherwise(F.lit(0.0))
        )
        counted = counted.withColumn(f"change_{days}d", change).withColumn(
            f"direction_{days}d",
            F.when(change > 0, "Increase").when(change < 0, "Decrease").otherwise("No change"),
        )
    return counted


def theme_criticality(themes: DataFrame, by: Sequence[str] = BY_APP, k: int = 10) -> DataFrame:
    """Complaint themes by count x |mean rating - 5| + 2 x votes, and their impact.

    Reads a ``sentiment_theme_summary``.
    """
    negative = themes.where(F.col("side") == "negative").drop("rank")
    parts = (F.col("count"), None, None, F.col("total_votes"), F.col("avg_rating"))
    scored = negative.withColumns({
        "criticality": criticality("count_inverse_rating_plus_votes", *parts),
        "impact": criticality("count_rating_plus_votes", *parts),
    }).select(*by, "theme_id", "count", "avg_rating", "total_votes", "criticality", "impact")
    return top_k(scored, by, [F.desc("criticality"), F.asc("theme_id")], k, rank="rank")


def health_explanation(health: DataFrame) -> DataFrame:
    """Reasons behind a health label.

    Reads ``overall_health, avg_rating, urgency_score, critical_issues,
    overall_sentiment`` and adds ``explanation``.
    """
    rating = F.format_string("%.1f", "avg_rating")
    reasons = F.array_compact(F.array(
        F.when(F.col("avg_rating") < 3.0, F.concat(F.lit("low average rating ("), rating, F.lit(" stars)"))),
        F.when(F.col("urgency_score") > 70, F.format_string("high urgency score (%d/100)", "urgency_score")),
        F.when(F.col("critical_issues") > 3, F.format_string("%d critical issues identified", "critical_issues")),
        F.when(F.lower("overall_sentiment") == "negative", F.lit("predominantly negative sentiment")),
    ))
    poor = F.when(
        F.size(reasons) > 0,
        F.concat(
            F.lit("Due to "), F.array_join(F.slice(reasons, 1, 2), " and "),
            F.when(F.size(reasons) > 2, " among other issues").otherwise(""),
        ),
    ).otherwise("Multiple critical issues requiring immediate attention")
    label = F.lower("overall_health")
    text = (
        F.when(label == "poor", poor)
        .when(label == "fair", F.concat(
            F.lit("Moderate concerns with "), rating, F.lit(" stars and "),
            F.col("critical_issues").cast("string"), F.lit(" priority issues to address"),
        ))
        .when(label == "good", F.concat(
            F.lit("Generally positive with "), rating, F.lit(" stars and manageable improvement areas")))
        .when(label == "excellent", F.concat(
            F.lit("Outstanding performance with "), rating, F.lit(" stars and minimal critical issues")))
        .otherwise("Health assessment unavailable")
    )
    return health.withColumn("explanation", text)


def star_sentiment(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Share of each star and of negative, neutral and positive stars."""
    counts = reviews.groupBy(*by).agg(
        F.count("*").alias("total_reviews"),
        *[F.count_if(F.col("rating") == star).alias(f"__s{star}") for star in STARS],
    )
    total, star = F.col("total_reviews"), lambda s: F.col(f"__s{s}")
    return counts.select(
        *by, "total_reviews",
        *[share(star(s), total).alias(f"stars_{s}_pct") for s in STARS],
        share(star(1) + star(2), total).alias("negative_pct"),
        share(star(3), total).alias("neutral_pct"),
        share(star(4) + star(5), total).alias("positive_pct"),
    )

