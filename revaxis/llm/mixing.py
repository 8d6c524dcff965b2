"""Mixing sources to target weights by whole copies and one hashed draw.

Tokens are summed by source. The weights share out all tokens; a source's target stops at
``most`` times its tokens and the excess is shared again by weight. ``target / tokens`` is
the source's repetition rate: each document is taken ``floor(rate)`` times, and once more
if a hash of its id and the seed, as a number between 0 and 1, is below the fraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Sources up to this number are sent to all executors; more are joined by a salted key.
BROADCAST_SOURCES = 20_000
SALTS = 32


def ranked(sources: DataFrame, source: str) -> DataFrame:
    """Add ``rank``, from 0 by code point with null last, without one task that sorts all.

    Rows are spread by range; a row's rank is its place in its part and the sizes of the
    parts before, which are as many numbers as there are parts.
    """
    order = [F.col(source).isNull(), F.col(source)]
    parts = written(
        sources.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
        "ranked",
    )
    found = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    starts, before = {}, 0
    for row in sorted(found, key=lambda r: r["part"]):
        starts[row["part"]] = before - row["first"]
        before += row["n"]
    if not starts:
        return parts.withColumn("rank", F.lit(0).cast("long")).drop("part", "place")
    offset = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
    return parts.withColumn("rank", (F.col("place") + offset[F.col("part")]).cast("long")).drop("part", "place")


def targets(sources: DataFrame, most: float) -> DataFrame:
    """Add ``target`` to ``(tokens, weight)`` rows.

    Every round the sources above ``most`` times their tokens are fixed there, and what is
    left is shared by weight among the others; two sums per round reach the driver. Sources
    without tokens get 0.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    limit = F.lit(float(most)) * F.col("tokens")
    share = None
    while total:
        held = F.lit(False) if share is None else limit <= F.lit(share) * F.col("weight")
        fixed, weight = sources.where(F.col("tokens") > 0).agg(
            F.sum(F.when(held, limit).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))
        ).first()
        if not weight:
            break
        new = (total - fixed) / weight
        if share is not None and new <= share:
            break
        share = new
    target = limit if share is None else F.least(limit, F.lit(share) * F.col("weight"))
    return sources.withColumn("target", F.when(F.col("tokens") > 0, target.cast("double")).otherwise(0.0))


def plan_mix(
    docs: DataFrame, size: str, source: str, doc_id: str,
    weight: Callable[[DataFrame], DataFrame], most: float = 3.0, seed: int = 11,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``source_size``, ``target`` and ``copies``.

    ``weight`` adds a column ``weight`` to the table ``(source, tokens)``. A null size counts
    as 0; null is a source like any other. Rows of the same id and source are taken alike.
    """
    key, salt = free_name(docs, "mix_source"), free_name(docs, "mix_salt")
    for name in ("source_size", "target", "copies"):
        if name in docs.columns:
            docs = docs.drop(name)
    summed = docs.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tokens"))
    table = written(targets(weight(written(summed, "sources")), most), "targets").select(
        F.col("source").alias(key), F.col("tokens").alias("source_size"), "target")
    if table.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), F.col(source).eqNullSafe(F.col(key)))
    else:
        spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(salt, F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")).join(
            spread.withColumnRenamed(salt, f"{salt}_"),
            F.col(source).eqNullSafe(F.col(key)) & (F.col(salt) == F.col(f"{salt}_")),
        ).drop(salt, f"{salt}_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id, source), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")).drop(key)


def mix(docs: DataFrame, **plan) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it had."""
    planned = plan_mix(docs, **plan)
    copy = free_name(planned, "copy")
    return planned.where(F.col("copies") > 0).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(f"`{c}`" for c in docs.columns))


def repeating_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ... ``cycle``, repeating over the sources by code point, null last."""
    return ranked(sources, "source").withColumn("weight", (F.col("rank") % cycle + 1).cast("double")).drop("rank")


def taken(size: Column, copies: Column) -> Column:
    return (size * copies).cast("long")
