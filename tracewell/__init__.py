"""Failure-pattern detection and event memory as Spark DataFrame functions."""

__version__ = "0.1.0"
