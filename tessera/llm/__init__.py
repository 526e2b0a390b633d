"""Operators for preparing training corpora at cluster scale."""
