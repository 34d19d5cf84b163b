"""Operators for training-data pipelines: fingerprints, scoring, dedup, rules, chat, secrets, toxicity, BPE, coding, packing.

Nothing else in the library imports this subpackage.
"""
