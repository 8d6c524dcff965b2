"""The per-row and time-window operators as streams."""

from .windows import deduplicated, negative_windows, scored_stream, windowed_alerts

__all__ = ["deduplicated", "negative_windows", "scored_stream", "windowed_alerts"]
