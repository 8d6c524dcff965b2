"""Score-to-label functions T9-T17."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.signals import COMPARISON_TYPES, URGENCY_WORDS
from ..rules.themes import CLUSTER_LABELS, GENERAL_COMPLAINTS
from .matching import as_column, first_label, matched_terms


def _banded(score: Column | str, bands, otherwise: str) -> Column:
    score = as_column(score)
    (edge, label), *rest = bands
    chain = F.when(score >= edge, label)
    for edge, label in rest:
        chain = chain.when(score >= edge, label)
    return chain.otherwise(otherwise)


def severity_level(score: Column | str) -> Column:
    """T9."""
    return _banded(score, ((4.5, "Critical"), (3.5, "High"), (2.5, "Medium")), "Low")


def priority_level(score: Column | str) -> Column:
    """T10."""
    return _banded(score, ((4.0, "High"), (3.0, "Medium")), "Low")


def satisfaction_level(score: Column | str) -> Column:
    """T11."""
    return _banded(score, ((4.5, "Very High"), (3.5, "High"), (2.5, "Medium")), "Low")


def rating_sentiment(rating: Column | str) -> Column:
    """Star rating as a sentiment label."""
    return _banded(rating, ((4, "positive"), (3, "neutral")), "negative")


def _keyword_factor(hits: Column) -> Column:
    return F.least(F.lit(1.5), F.lit(1.0) + (hits - 1) * F.lit(0.1))


def issue_severity(text: str, rating, severity, keywords: Iterable[str]) -> Column:
    """Issue severity of 1-5 from a level, the rating and the keywords found."""
    severity = as_column(severity)
    base = (
        F.when(severity == "low", 1).when(severity == "medium", 3).when(severity == "high", 4)
        .when(severity == "critical", 5)
    )
    hits = F.size(matched_terms(text, keywords))
    return F.least(F.lit(5.0), base * ((F.lit(6) - as_column(rating)) / 5) * _keyword_factor(hits))


def feature_priority(text: str, rating, priority, keywords: Iterable[str]) -> Column:
    """Feature priority of 1-5 from a level, the rating and the keywords found."""
    priority = as_column(priority)
    base = F.when(priority == "low", 2).when(priority == "medium", 3).when(priority == "high", 4)
    hits = F.size(matched_terms(text, keywords))
    return F.least(F.lit(5.0), base * (as_column(rating) / 5) * _keyword_factor(hits))


def feedback_urgency(text: str) -> Column:
    """critical, high, medium or low by urgency words."""
    return first_label(text, URGENCY_WORDS, "low")


def comparison_type(text: str) -> Column:
    """Kind of a competitor comparison."""
    return first_label(text, COMPARISON_TYPES, "general_mention")


def cluster_label(phrase: str, cluster_id: Column | str) -> Column:
    """Readable label from a cluster's top phrase; a numbered one if it has none."""
    named = first_label(phrase, CLUSTER_LABELS, GENERAL_COMPLAINTS)
    numbered = F.concat(F.lit("Cluster "), (as_column(cluster_id) + 1).cast("string"))
    return F.when(F.expr(phrase).isNull(), numbered).otherwise(named)
