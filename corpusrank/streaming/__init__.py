"""Structured Streaming entry points for the row-local operators."""
