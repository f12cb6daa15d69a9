"""Operators for preparing text corpora: dedup, scoring, decontamination, mixing, sharding, PII.

Nothing outside this subpackage imports it.
"""
