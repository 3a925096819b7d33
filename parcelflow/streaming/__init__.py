"""Structured Streaming: ingest into the lake and alerts on changed state."""
