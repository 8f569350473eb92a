"""Structured Streaming forms of the engine's roll-ups (an extension)."""
