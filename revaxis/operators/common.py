"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Percentage, null for an empty whole."""
    return F.try_divide(part, whole) * 100


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows per group.

    Catalyst limits each map partition to ``k`` rows per group before the shuffle
    (WindowGroupLimit), so a group of any size reaches the reducer with few rows.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row numbers within a group; for aggregated rows only."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def explode_counting_all(df: DataFrame, items: str, name: str) -> DataFrame:
    """Explode an array column plus one null item per row.

    The null item stands for the row itself, so group totals come out of the same scan
    and the same aggregation as the per-item figures (see ``spread_totals``).
    """
    kind = df.schema[items].dataType.simpleString()
    with_row = F.concat(F.array(F.lit(None)).cast(kind), F.coalesce(F.col(items), F.array().cast(kind)))
    return df.select(
        *[F.col(c) for c in df.columns if c != items], F.explode(with_row).alias(name)
    )


def spread_totals(aggregated: DataFrame, by: Sequence[str], item: str, totals: dict[str, str]) -> DataFrame:
    """Turn the null-item row of each group into columns of the group's other rows.

    ``totals`` maps a column of the null row to the name of its copy. The window runs
    over aggregated rows: one per group and item.
    """
    group = W.partitionBy(*by)
    for source, target in totals.items():
        aggregated = aggregated.withColumn(
            target, F.max(F.when(F.col(item).isNull(), F.col(source))).over(group)
        )
    return aggregated.where(F.col(item).isNotNull())


def exact_sum(value: Column | str, digits: int = 9) -> Column:
    """Sum of doubles as decimals: the same to the last digit whatever the row order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast(f"decimal(20,{digits})")).cast("double")
