"""Sluicework: source-tree and corpus quality analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
