"""Validation, routing and measurement of text-mention records as Spark DataFrame plans."""
