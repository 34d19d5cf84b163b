"""Evaluation-integrity analytics on PySpark."""
