"""App dimension: formatting and look-up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet


def format_apps(apps: DataFrame) -> DataFrame:
    """Display columns of an app table."""
    free = F.coalesce(F.col("free"), F.lit(True))
    score = F.coalesce(F.col("score"), F.lit(0.0)).cast("double")
    return apps.select(
        F.coalesce("app_id", F.lit("")).alias("app_id"),
        F.coalesce("title", F.lit("Unknown App")).alias("title"),
        F.coalesce("developer", F.lit("Unknown Developer")).alias("developer"),
        snippet(F.coalesce("description", F.lit("")), 150).alias("summary"),
        score.alias("score"),
        F.when(score == 0, "N/A").otherwise(F.format_string("%.1f", score)).alias("score_text"),
        F.when(free, "Free")
        .otherwise(F.concat(F.lit("$"), F.coalesce("price", F.lit(0.0)).cast("string")))
        .alias("price_text"),
        free.alias("free"),
        F.concat(F.lit("https://play.google.com/store/apps/details?id="), F.coalesce("app_id", F.lit("")))
        .alias("url"),
    )


def attach_app_metadata(report: DataFrame, apps: DataFrame, columns: Iterable[str] = ()) -> DataFrame:
    """Report rows with their app's columns, null where the app is unknown.

    No broadcast hint: Spark broadcasts the dimension when its measured size allows.
    """
    columns = list(columns) or [name for name in apps.columns if name != "app_id"]
    return report.join(apps.select("app_id", *columns), "app_id", "left")
