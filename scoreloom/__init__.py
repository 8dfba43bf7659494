"""Scoring-model building blocks for flat tables, expressed as Spark DataFrame operators."""
