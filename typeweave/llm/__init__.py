"""Operators for training-data pipelines; nothing else in typeweave imports this."""
