"""Operators for preparing text corpora for model training, and their registered queries."""
