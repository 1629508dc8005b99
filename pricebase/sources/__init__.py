"""Readers, reference dimensions, ingest and sinks."""
