"""Spark-native engine for evaluating web-extraction rules over large page corpora."""
