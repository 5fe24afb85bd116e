"""Spark-native toolkit for auditing how text collections drift, and for preparing training corpora."""
