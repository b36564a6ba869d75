"""Operators for preparing training corpora: mixing, filtering, deduplication, scoring.

Nothing outside this package imports it.
"""
