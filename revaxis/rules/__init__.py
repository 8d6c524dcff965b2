"""Rule sets and word lists: plain data, no Spark needed to import them."""

from .model import Category, merge_rules
from .categories import APP_TYPE_RULES, DEFAULT_RULES, rules_for

__all__ = ["APP_TYPE_RULES", "DEFAULT_RULES", "Category", "merge_rules", "rules_for"]
