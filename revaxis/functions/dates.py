"""Readable review dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import as_column

_DISPLAY = "MMMM dd, yyyy"


def normalize_review_date(value: Column | str, as_of: Column) -> Column:
    """Dates in the forms stores use, as ``January 05, 2024`` or a readable approximation.

    Epoch seconds, ISO dates, "N days/months/years ago" and "Month d, yyyy" are known; a
    year after ``as_of`` is taken back to its year; anything else stays as it is.
    """
    value = as_column(value)
    year = F.year(as_of).cast("string")
    low = F.lower(value)
    epoch = value.try_cast("bigint")
    years_ago = F.regexp_extract(value, r"(\d+)", 1)
    written_year = F.regexp_extract(value, r"(\d{4})", 1)
    iso = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))
    return (
        F.when(value.isNull() | (value == "") | (value == "Unknown"), "Unknown")
        .when(value.rlike(r"^\d+$") & (epoch > 1000000000), F.date_format(F.timestamp_seconds(epoch), _DISPLAY))
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}") & iso.isNotNull(), F.date_format(iso, _DISPLAY))
        .when(F.contains(low, F.lit("ago")) & value.rlike("month|day"), F.concat(F.lit("Recent ("), year, F.lit(")")))
        .when(
            F.contains(low, F.lit("ago")) & F.contains(value, F.lit("year")) & (years_ago != ""),
            F.concat(F.lit("Approximately "), (F.year(as_of) - years_ago.try_cast("int")).cast("string")),
        )
        .when(
            value.rlike(r"^[\p{L}\p{N}_]+ \d{1,2}, \d{4}") & (written_year.try_cast("int") > F.year(as_of)),
            F.replace(value, written_year, year),
        )
        .otherwise(value)
    )
