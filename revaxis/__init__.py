"""Review analytics on Spark: DataFrame operators over a table of app reviews."""

from .schema import REVIEW_SCHEMA

__all__ = ["REVIEW_SCHEMA"]
