"""Structured Streaming twins of the status, completion and scoring operators."""
