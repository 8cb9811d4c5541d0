"""Structured Streaming sources, stateful operators and idempotent sinks."""
