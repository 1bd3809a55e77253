"""Operators for training-data pipelines over document and conversation tables."""
