"""Headwater: a Spark-native engine for analysing and restoring the heading structure of markdown corpora."""

__version__ = "0.1.0"
