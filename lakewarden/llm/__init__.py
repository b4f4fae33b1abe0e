"""Operators of a training-data pipeline; see README.md, "Training data"."""
