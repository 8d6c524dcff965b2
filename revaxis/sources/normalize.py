"""Review dumps in any of the known shapes -> the canonical review row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schema import REVIEW_SCHEMA

# Accepted column names per canonical column, first non-empty one wins.
ALIASES = {
    "review_id": ("review_id", "reviewId"),
    "app_id": ("app_id", "appId"),
    "user_name": ("user_name", "userName", "author"),
    "rating": ("rating", "score"),
    "review": ("content", "review", "text"),
    "at": ("at", "date"),
    "thumbs_up": ("thumbs_up", "thumbsUpCount"),
}


def normalize_reviews(
    df: DataFrame,
    app_id: str = "unknown",
    votes_default: int | None = 0,
    as_of: Column | None = None,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Resolve aliases, fill defaults, cast, and drop rows without text.

    Rows without an id get a hash of their columns, so an exact copy shares its id. Rows
    without an app get ``app_id``: reports join on it, and null keys would drop out.
    ``keep`` names further columns (e.g. ``cluster_id``) to pass through.
    """
    names = {name.lower(): name for name in df.columns}

    def known(target: str) -> list[Column]:
        columns = [F.col(f"`{names[a.lower()]}`") for a in ALIASES[target] if a.lower() in names]
        if target in ("review", "review_id", "app_id", "user_name"):
            return [F.nullif(column.cast("string"), F.lit("")) for column in columns]
        return columns

    every = F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]))
    defaults = {
        "review_id": F.sha2(every, 256),
        "app_id": F.lit(app_id),
        "user_name": F.lit("Anonymous"),
        "rating": F.lit(3),
        "review": F.lit(None),
        "at": as_of if as_of is not None else F.lit(None),
        "thumbs_up": F.lit(votes_default),
    }
    columns = []
    for field in REVIEW_SCHEMA.fields:
        kind = field.dataType.simpleString()
        candidates = [column.try_cast(kind) for column in known(field.name)]
        columns.append(F.coalesce(*candidates, defaults[field.name].cast(kind)).alias(field.name))
    rows = df.select(*columns, *[F.col(f"`{name}`") for name in keep])
    return rows.where(F.length(stripped("review")) > 0)
