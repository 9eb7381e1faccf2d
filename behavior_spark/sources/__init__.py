"""Readers, stored tables and their sinks."""
