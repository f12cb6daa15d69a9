"""Operators over change logs: versions, transactions, ordering, compaction and metrics."""
