"""Evaluation and corpus checks for speech-to-text output, as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
