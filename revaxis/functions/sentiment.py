"""Sentiment scoring on columns (N2-N4 and the model labels of N5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.words import NEGATIVE_WORDS, POSITIVE_WORDS
from .matching import as_column, on_text, sql_contained, sql_let, sql_struct


def compound_label(compound: Column | str) -> Column:
    compound = as_column(compound)
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def polarity_label(polarity: Column | str) -> Column:
    polarity = as_column(polarity)
    return F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral")


def keyword_boost(text: str) -> Column:
    """Balance of distinct positive and negative words, within +-0.3."""
    counts = sql_struct(
        p=f"size({sql_contained('_t', POSITIVE_WORDS)})", n=f"size({sql_contained('_t', NEGATIVE_WORDS)})"
    )
    balance = "CASE WHEN _c.p + _c.n = 0 THEN 0.0D ELSE (_c.p - _c.n) / (_c.p + _c.n) * 0.3D END"
    return on_text(text, sql_let("_c", counts, balance))


def weighted_score(compound, polarity, boost) -> Column:
    return (
        as_column(compound) * F.lit(0.5) + as_column(polarity) * F.lit(0.3) + as_column(boost) * F.lit(0.2)
    )


def hybrid_label(weighted: Column | str) -> Column:
    weighted = as_column(weighted)
    return F.when(weighted >= 0.1, "positive").when(weighted <= -0.1, "negative").otherwise("neutral")


def hybrid_confidence(label, weighted, compound, polarity, boost) -> Column:
    """Share of scorers that agree with ``label``, scaled by the size of the score."""
    label, weighted, boost = as_column(label), as_column(weighted), as_column(boost)
    agreement = (
        (compound_label(compound) == label).cast("int") + (polarity_label(polarity) == label).cast("int")
    ) / 2
    backed = ((label == "positive") & (boost > 0)) | ((label == "negative") & (boost < 0))
    agreement = F.when(backed, F.least(F.lit(1.0), agreement + F.lit(0.2))).otherwise(agreement)
    return agreement * F.least(F.lit(1.0), F.abs(weighted) * 2)


def model_label(raw_label: Column | str) -> Column:
    """Classifier label ids as sentiment names; other labels are lower-cased."""
    raw_label = as_column(raw_label)
    return (
        F.when(raw_label == "LABEL_0", "negative").when(raw_label == "LABEL_1", "neutral")
        .when(raw_label == "LABEL_2", "positive").otherwise(F.lower(raw_label))
    )


def model_polarity(label: Column | str, confidence: Column | str) -> Column:
    label, confidence = as_column(label), as_column(confidence)
    return F.when(label == "positive", confidence).when(label == "negative", -confidence).otherwise(F.lit(0.0))
