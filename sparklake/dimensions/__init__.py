"""Slowly changing dimensions."""
