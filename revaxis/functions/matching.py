"""Ordered term matching on lower-cased text (plain substring, not whole words).

Rule-heavy expressions are written as SQL text (the ``sql_*`` builders) and parsed once:
a rule set has hundreds of literals, and building those one Column call at a time takes
seconds on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    Without this, the optimizer inlines e.g. ``lower(review)`` into the lambda of a
    ``filter`` over terms and lower-cases the text again for every term (3x slower).
    """
    return F.transform(F.array(as_column(value)), body)[0]


# --- SQL builders ---------------------------------------------------------------------


def sql_literal(value) -> str:
    """A Python value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_pattern(pattern: str) -> str:
    """A pattern of the rules as a literal: classes and borders for all letters, and only \\n ends a line.

    Without the flag U, what \\b means for accented letters differs between JDKs.
    """
    return sql_literal("(?dU)" + pattern)


def sql_array(terms: Iterable[str]) -> str:
    items = ", ".join(sql_literal(term) for term in terms)
    return f"array({items})" if items else "cast(array() as array<string>)"


def sql_let(name: str, value: str, body: str) -> str:
    """``body`` with the variable ``name`` holding ``value``, evaluated once (see ``let``)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_contained(text: str, terms: Iterable[str]) -> str:
    """Array of the terms in ``text``, in order; ``text`` is a column or a variable."""
    return f"filter({sql_array(terms)}, _k -> contains({text}, _k))"


def sql_first(text: str, terms: Iterable[str]) -> str:
    return f"get({sql_contained(text, terms)}, 0)"


def sql_any(text: str, terms: Iterable[str]) -> str:
    tests = " OR ".join(f"contains({text}, {sql_literal(term)})" for term in terms)
    return f"({tests})" if tests else "false"


def _alternatives(pattern: str) -> list[list[str]]:
    """The plain pieces between the gaps of each alternative of ``(one|two.*three)``, with or without word
    borders; no alternatives for any other pattern."""
    listed = re.fullmatch(r"(?:\\b)?\((.*)\)(?:\\b)?", pattern)
    found = [re.split(r"\.\*|\\d\+", alternative) for alternative in listed[1].split("|")] if listed else []
    if not all(re.fullmatch(r"(?:[\w' ]|\\\$)*", piece) for pieces in found for piece in pieces):
        return []
    return [[piece.replace("\\$", "$") for piece in pieces] for pieces in found]


def pattern_pieces(pattern: str) -> list[tuple[str, ...]]:
    """Sets of plain pieces: every match of ``pattern`` holds all pieces of one; none if that can't be told."""
    found = set()
    for pieces in _alternatives(pattern):
        plain = {piece for piece in pieces if piece}
        # A piece within another one adds nothing.
        found.add(tuple(sorted(p for p in plain if not any(o != p and p in o for o in plain))))
    if () in found:
        return []

    def implied(pieces, others):
        return all(any(other in piece for piece in pieces) for other in others)

    return sorted(f for f in found if not any(o != f and implied(f, o) for o in found))


def sql_may_match(text: str, pattern: str) -> str:
    """A cheap test that holds for every ``text`` in which ``pattern`` is found."""
    tests = " OR ".join(
        "(" + " AND ".join(f"contains({text}, {sql_literal(piece)})" for piece in pieces) + ")"
        for pieces in pattern_pieces(pattern)
    )
    return f"({tests})" if tests else "true"


def _sought(pattern: str) -> str:
    """``pattern`` as a literal, tried only at the letters that a match can begin with, if they are known."""
    first = {pieces[0][:1] for pieces in _alternatives(pattern)}
    return sql_pattern(pattern if not first or "" in first else f"(?=[{''.join(sorted(first))}]){pattern}")


def sql_found(text: str, pattern: str) -> str:
    """Whether a pattern of the rules is found in ``text``, a column or a variable."""
    return f"({sql_may_match(text, pattern)} AND rlike({text}, {_sought(pattern)}))"


def sql_count(text: str, pattern: str) -> str:
    """How often a pattern of the rules is found in ``text``; null for null."""
    return f"if(NOT {sql_may_match(text, pattern)}, 0, regexp_count({text}, {_sought(pattern)}))"


def sql_first_label(text: str, labelled_terms, otherwise: str | None) -> str:
    cases = " ".join(
        f"WHEN {sql_any(text, terms)} THEN {sql_literal(label)}" for label, terms in labelled_terms
    )
    return f"CASE {cases} ELSE {sql_literal(otherwise)} END"


def sql_struct(**fields: str) -> str:
    """A struct of SQL expressions."""
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def on_text(text: str, body: str, variable: str = "_t") -> Column:
    """``body`` over the variable ``_t``, the lower-cased text, as a column.

    ``text`` is a column name or a SQL expression.
    """
    return F.expr(sql_let(variable, f"lower({text})", body))


# --- Column functions -----------------------------------------------------------------


def term_array(terms: Iterable[str]) -> Column:
    return F.expr(sql_array(terms))


def contained_terms(text: Column, terms: Iterable[str]) -> Column:
    """Terms found in ``text``; ``text`` must be cheap (a column or a ``let`` variable)."""
    return F.filter(term_array(terms), lambda term: F.contains(text, term))


def matched_terms(text: str, terms: Iterable[str]) -> Column:
    """All terms contained in the lower-cased text, in rule order (T4)."""
    return on_text(text, sql_contained("_t", terms))


def first_term(text: str, terms: Iterable[str]) -> Column:
    """First term, in rule order, contained in the lower-cased text, else null (T4)."""
    return on_text(text, sql_first("_t", terms))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether already lower-cased ``text`` contains one of the terms."""
    return F.exists(term_array(terms), lambda term: F.contains(text, term))


def first_label(text: str, labelled_terms, otherwise: str | None = None) -> Column:
    """Label of the first entry of ``(label, terms)`` pairs with a term in the text."""
    return on_text(text, sql_first_label("_t", labelled_terms, otherwise))
