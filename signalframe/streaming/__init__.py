"""Structured Streaming: incremental frames, retention, template mining."""
