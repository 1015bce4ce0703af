"""Sensitive-text analytics on Spark: detection, masking, restoring and scoring as DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
