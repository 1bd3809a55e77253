"""Condition-monitoring analytics as Spark DataFrame operators."""
