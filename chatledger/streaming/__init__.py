"""Structured Streaming jobs that keep the derived tables fresh."""
