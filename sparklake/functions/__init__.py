"""Reusable column functions and vectorised UDFs."""
