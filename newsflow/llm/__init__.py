"""Operators for training-data pipelines over corpora of any size."""
