"""The canonical review row."""

from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("thumbs_up", T.LongType()),
])

REVIEW_COLUMNS = tuple(REVIEW_SCHEMA.fieldNames())

# Grouping keys used when the caller names none.
BY_APP = ("app_id",)
