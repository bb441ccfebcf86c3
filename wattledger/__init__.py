"""Utility-loss analytics for electricity distributors, expressed as Spark plans."""

__version__ = "0.1.0"
