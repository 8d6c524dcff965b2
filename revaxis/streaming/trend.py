"""Negative trend kept up by a stream (R2, A11): daily counts by batch, replays without effect."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.statistics import trend_changes
from ..schema import BY_APP


def trend_sink(folder: str, by: Sequence[str] = BY_APP) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: writes a batch's reviews and negative reviews per group and day.

    A batch has a folder named by its id, so one that is run again replaces itself. Reviews
    may come in any order and as late as they like. ``folder`` is one that all executors share.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(*by, F.date_trunc("day", "at").alias("day")).agg(
            F.count("*").alias("reviews"), F.count_if(F.col("rating") <= 2).alias("negative"))
        counted.write.mode("overwrite").parquet(f"{folder}/first={batch_id}/last={batch_id}")

    return write


def daily_counts(
    spark: SparkSession, folder: str, by: Sequence[str] = BY_APP, last: int | None = None
) -> DataFrame:
    """Reviews and negative reviews per group and day over all batches, or those up to ``last``.

    Reviews without a time have a null day.
    """
    parts = spark.read.parquet(folder)
    folds = (F.col("first") == 0) & (F.col("last") > 0)
    if last is not None:
        # A fold is written from its batches or a smaller fold, so that writing it again does not read it.
        parts, folds = parts.where(F.col("last") <= last), folds & (F.col("last") < last)
    # One number: where the largest fold ends.
    folded = parts.where(folds).agg(F.max("last")).first()[0]
    single = F.col("first") == F.col("last")
    current = parts.where(single) if folded is None else parts.where(
        (single & (F.col("first") > folded)) | ((F.col("first") == 0) & (F.col("last") == folded)))
    return current.groupBy(*by, "day").agg(F.sum("reviews").alias("reviews"), F.sum("negative").alias("negative"))


def fold_batches(spark: SparkSession, folder: str, last: int, by: Sequence[str] = BY_APP) -> None:
    """Write the sums of the batches from 0 to ``last``, all of them done, as one part that readers then use.

    The batches' own folders stay and are skipped; their owner may delete them.
    """
    counts = daily_counts(spark, folder, by, last)
    counts.write.mode("overwrite").parquet(f"{folder}/first=0/last={last}")


def live_negative_trend(
    spark: SparkSession, folder: str, as_of: Column, by: Sequence[str] = BY_APP, windows: Sequence[int] = (14, 60)
) -> DataFrame:
    """The figures of ``negative_trend`` from the daily counts, as of the start of ``as_of``'s day."""
    day, negative = F.date_trunc("day", as_of), F.col("negative")

    def within(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, negative)), F.lit(0))

    figures = [F.sum("negative").alias("total_negative")]
    for days in windows:
        recent, before = (day - F.make_dt_interval(F.lit(n * days)) for n in (1, 2))
        figures.append(within(F.col("day") >= recent).alias(f"recent_{days}d"))
        figures.append(within((F.col("day") >= before) & (F.col("day") < recent)).alias(f"previous_{days}d"))
    return trend_changes(daily_counts(spark, folder, by).groupBy(*by).agg(*figures), windows)
