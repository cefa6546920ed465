"""Evaluation plans: expansion, validation, pruning, and scoring with pluggable models."""
