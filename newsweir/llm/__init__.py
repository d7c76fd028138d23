"""Operators for text corpora and model training data; nothing outside imports this package."""

PLANS = ["newsweir.llm.queries"]
