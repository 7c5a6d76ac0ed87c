"""Matching, statistics, explanation and rule-set management."""
