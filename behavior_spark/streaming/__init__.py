"""Structured Streaming: ingest fan-out and stateful tracker rules."""
