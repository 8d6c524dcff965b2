"""Immutable rule model. Order is significant everywhere: the first match wins."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Category:
    """One classification rule: gate keywords plus ordered subcategories."""

    id: str
    name: str
    keywords: tuple[str, ...]
    subcategories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    alert_threshold: float = 0.05
    priority_multiplier: float = 1.0

    @property
    def group(self) -> str:
        """Report section a category is routed to, by id prefix."""
        if self.id == "feature_requests":
            return "feature_requests"
        for prefix, group in (
            ("ux_", "ux_issues"),
            ("critical_", "critical_complaints"),
            ("tech_", "tech_issues"),
        ):
            if self.id.startswith(prefix):
                return group
        return "other_issues"


def category(id, name, threshold, multiplier, keywords, **subcategories) -> Category:
    return Category(
        id,
        name,
        keywords,
        subcategories,
        threshold,
        multiplier,
    )


def merge_rules(base, *overrides) -> tuple[Category, ...]:
    """Later rule sets replace categories of the same id in place and append new ones."""
    merged = {rule.id: rule for rule in base}
    for rules in overrides:
        merged.update({rule.id: rule for rule in rules})
    return tuple(merged.values())
