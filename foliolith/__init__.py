"""Spark-first analytics for semi-structured technical documents."""
