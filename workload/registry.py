"""Query registry: a name, a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .data import DOCUMENTS_SQL, REVIEWS_SQL, _list, _quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

quoted, sql_list = _quoted, _list


def query(name: str, sql: str | None = None, documents: bool = False, ctes: bool = True):
    """Register a query; ``sql`` continues a WITH list that already defines the reviews."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            prefix = f"WITH {DOCUMENTS_SQL if documents else REVIEWS_SQL}" if ctes else ""
            body = sql.strip()
            ORACLES[name] = f"{prefix}{', ' if ctes and not body.upper().startswith('SELECT') else ' '}{body}".strip()
        return fn

    return register


def hits(text: str, terms) -> str:
    """List of the terms a text contains, in order."""
    return f"list_filter({_list(terms)}, lambda k: contains({text}, k))"


def first(text: str, terms) -> str:
    return f"{hits(text, terms)}[1]"


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(term)})" for term in terms) + ")"


def values(name: str, columns: str, rows) -> str:
    """A CTE of literal rows."""

    def literal(value):
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return _quoted(value)
        return repr(value)

    listed = ",\n ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {listed})"


def clip(text: str, size: int) -> str:
    return f"CASE WHEN length({text}) > {size} THEN substr({text}, 1, {size}) || '...' ELSE {text} END"


def banded(score: str, bands, otherwise: str) -> str:
    cases = " ".join(f"WHEN {score} >= {edge} THEN {_quoted(label)}" for edge, label in bands)
    return f"CASE {cases} ELSE {_quoted(otherwise)} END"


SEVERITY_BANDS = ((4.5, "Critical"), (3.5, "High"), (2.5, "Medium"))
PRIORITY_BANDS = ((4.0, "High"), (3.0, "Medium"))
SATISFACTION_BANDS = ((4.5, "Very High"), (3.5, "High"), (2.5, "Medium"))
RATING_BANDS = ((4, "positive"), (3, "neutral"))
