"""Structured Streaming: idempotent ingest and stateful progress tracking."""
