"""Operators over the media tables; importing the modules registers their queries."""

from mediasift.operators import catalog, claims, dedup, headers, pictures, scoring, signals, timeline

__all__ = ["catalog", "claims", "dedup", "headers", "pictures", "scoring", "signals", "timeline"]
