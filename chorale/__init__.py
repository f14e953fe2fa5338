"""Chorale: a PySpark-native engine for scoring multi-agent policy simulations."""

__version__ = "0.1.0"
