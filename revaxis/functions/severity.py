"""Issue flags, severity and complaint tags of one review."""

from __future__ import annotations

from pyspark.sql import Column

from ..rules.signals import COMPLAINT_TAGS, FLAG_PATTERNS, SEVERITY_PATTERNS
from .matching import on_text, sql_count, sql_found, sql_let, sql_literal, sql_struct

LEVELS = tuple(SEVERITY_PATTERNS)


def issue_flags(text: str) -> Column:
    """Struct of ``fraud_related, money_related, update_related``."""
    flags = {
        name: " OR ".join(sql_found("_t", pattern) for pattern in patterns)
        for name, patterns in FLAG_PATTERNS.items()
    }
    return on_text(text, sql_struct(**flags))


def severity_of(text: str, rating: str = "rating") -> Column:
    """Struct ``(severity, severity_score)`` from pattern counts, rating and length (C20)."""
    hits = {
        level: " + ".join(sql_count("_t", pattern) for pattern in patterns)
        for level, patterns in SEVERITY_PATTERNS.items()
    }
    points = sql_struct(
        critical=f"{hits['critical']} + if({rating} <= 2, 2, 0)",
        severe=f"{hits['severe']} + if({rating} <= 3, 1, 0) + if(length({text}) > 200, 1, 0)",
        minor=hits["minor"],
    )
    top = "greatest(" + ", ".join(f"_p.{level}" for level in LEVELS) + ")"
    # Equal points are decided in the order critical, severe, minor.
    level = "CASE _top " + " ".join(f"WHEN _p.{name} THEN '{name}'" for name in LEVELS) + " END"
    decided = sql_struct(
        severity=f"if(_top = 0, 'minor', {level})",
        severity_score="if(_top = 0, 0.1D, least(_top / 5, 1.0D))",
    )
    return on_text(text, sql_let("_p", points, sql_let("_top", top, decided)))


def complaint_tags(text: str) -> Column:
    """Array of complaint theme tags, in fixed order."""
    tags = ", ".join(
        f"if({sql_found('_t', pattern)}, {sql_literal(tag)}, NULL)" for tag, pattern in COMPLAINT_TAGS.items()
    )
    return on_text(text, f"array_compact(array({tags}))")
