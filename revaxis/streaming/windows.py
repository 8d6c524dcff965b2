"""Streaming operators; every one also runs on a batch DataFrame with the same result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import keyword_boost
from ..operators.classify import CRITICAL, classification_flags, review_tags
from ..operators.common import share, top_k
from ..operators.signals import enhance_reviews
from ..rules import DEFAULT_RULES
from ..schema import BY_APP


def scored_stream(reviews: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Per-review boost, classification flags, severity and issue flags; stateless."""
    return classification_flags(
        enhance_reviews(reviews).withColumn("keyword_boost", keyword_boost("review")), rules
    )


def negative_windows(
    reviews: DataFrame, by: Sequence[str] = BY_APP, size: str = "14 days", slide: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Reviews and negative reviews per time window (R2); rows later than ``delay`` are dropped."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    counted = reviews.withWatermark("at", delay).groupBy(*by, window.alias("window")).agg(
        F.count("*").alias("total_reviews"), F.count_if(F.col("rating") <= 2).alias("negative_reviews")
    )
    return counted.select(
        *by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "total_reviews", "negative_reviews",
        share(F.col("negative_reviews"), F.col("total_reviews")).alias("negative_pct"),
    )


def windowed_alerts(
    reviews: DataFrame, by: Sequence[str] = BY_APP, size: str = "14 days", slide: str | None = None,
    delay: str = "1 day", rules=DEFAULT_RULES,
) -> DataFrame:
    """Windows in which critical complaints pass 5% of the reviews; 10% is HIGH (R2)."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    is_critical = F.exists(review_tags("review", rules), lambda tag: tag["grp"] == CRITICAL)
    rows = reviews.withWatermark("at", delay).select(*by, "at", is_critical.alias("__critical"))
    counted = rows.groupBy(*by, window.alias("window")).agg(
        F.count("*").alias("total_reviews"), F.count_if("__critical").alias("critical_reviews")
    )
    limit = F.greatest(F.lit(1), F.floor(F.col("total_reviews") * 0.05))
    return counted.where(F.col("critical_reviews") >= limit).select(
        *by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "total_reviews", "critical_reviews",
        F.when(F.col("critical_reviews") >= limit * 2, "HIGH").otherwise("MEDIUM").alias("alert_level"),
    )


def deduplicated(reviews: DataFrame, delay: str = "1 day", id_column: str = "review_id") -> DataFrame:
    """One row per review id among rows up to ``delay`` apart.

    Of a batch a row goes if another of its id stands up to ``delay`` before it; of rows at the
    same time the one whose other columns are lowest comes first, so reruns agree. Rows without a
    time go before all others of their id. A stream keeps the row that arrives first, and forgets
    an id once the watermark is ``delay`` past that row.
    """
    if not reviews.isStreaming:
        order = [F.asc("at"), *[F.asc(c) for c in reviews.columns if c not in ("at", id_column)]]
        of_id = W.partitionBy(id_column).orderBy(*order)
        before = F.lag("at").over(of_id) + F.expr(f"INTERVAL {delay}")
        marked = reviews.withColumn("__n", F.row_number().over(of_id)).withColumn("__until", before)
        return marked.where((F.col("__n") == 1) | (F.col("at") > F.col("__until"))).drop("__n", "__until")
    return reviews.withWatermark("at", delay).dropDuplicatesWithinWatermark([id_column])


def earliest(
    reviews: DataFrame, delay: str = "1 day", lateness: str | None = None, id_column: str = "review_id"
) -> DataFrame:
    """The earliest row of every run of rows of one id with gaps of less than ``delay``.

    Batch and stream give equal rows: a stream gives a run's row once the watermark, ``lateness``
    (default ``delay``) behind the newest row, has passed the run, so a row that comes late but in
    time takes the place of later ones. Of rows at the same time the lowest in the other columns
    stays. Rows without a time have no distance to others and stay, all of them.
    """
    timed = reviews.withWatermark("at", lateness or delay) if reviews.isStreaming else reviews
    others = [name for name in reviews.columns if name != "at"]
    runs = timed.groupBy(F.col(id_column).alias("__id"), F.session_window("at", delay)).agg(
        F.min(F.struct("at", *others)).alias("__first"))
    first = runs.select(*(F.col("__first")[name].alias(name) for name in reviews.columns))
    return first.unionByName(reviews.where("at IS NULL"))
