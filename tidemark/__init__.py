"""Versioned key-value analytics over immutable change logs, as Spark DataFrame plans."""
