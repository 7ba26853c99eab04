"""Arcloom: code-feature analytics expressed as Spark DataFrame plans."""

__all__ = ["tables", "operators", "functions", "plans", "sources", "streaming"]
