"""Data-quality rules, reports and quarantine."""

from sparklake.quality.rules import Report, Rule, run, split, with_flags

__all__ = ["Report", "Rule", "run", "split", "with_flags"]
