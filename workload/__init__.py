"""Registered queries and their SQL twins over the driver's tables."""

from importlib import import_module

MODULES = (
    "basics", "sentiment", "classification", "themes", "signals", "phrases", "clusters", "streams",
)


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
