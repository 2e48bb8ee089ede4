"""Operators of a training-data pipeline, each a DataFrame job of its own."""
