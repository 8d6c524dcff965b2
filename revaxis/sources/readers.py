"""Review dumps as DataFrames and streams."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import as_column
from ..operators.common import top_k
from ..schema import BY_APP

# Column names and types a raw dump may use; a reader with a schema never infers one.
RAW_SCHEMA = T.StructType([
    T.StructField("reviewId", T.StringType()),
    T.StructField("appId", T.StringType()),
    T.StructField("userName", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("at", T.StringType()),
    T.StructField("thumbsUpCount", T.LongType()),
])


def read_reviews(
    spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = None, **options
) -> DataFrame:
    """Raw dump; pass it to ``normalize_reviews``. Parquet and ORC bring their own schema."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("json", "csv"):
        reader = reader.schema(schema or RAW_SCHEMA)
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def stream_reviews(
    spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = None, **options
) -> DataFrame:
    """The same dump as a stream: new files in the folder are new reviews."""
    return spark.readStream.format(fmt).schema(schema or RAW_SCHEMA).options(**options).load(path)


def newest_reviews(reviews: DataFrame, count: int, by: Sequence[str] = BY_APP) -> DataFrame:
    """The newest ``count`` reviews of each group."""
    return top_k(reviews, by, [F.desc("at"), F.asc("review_id")], count)


def extract_app_id(url: Column | str) -> Column:
    """App id from a store URL, null if it has none (S3)."""
    return F.nullif(F.regexp_extract(as_column(url), r"id=([a-zA-Z0-9_.]+)", 1), F.lit(""))


def filter_ratings(reviews: DataFrame, stars: Iterable[int] = ()) -> DataFrame:
    """Keep the given star ratings; none given keeps all."""
    stars = list(stars)
    return reviews.where(F.col("rating").isin(stars)) if stars else reviews


def negative_only(reviews: DataFrame) -> DataFrame:
    """One and two star reviews."""
    return reviews.where(F.col("rating") <= 2)
