"""Batch and streaming pipelines of bronze, silver and gold layers."""
