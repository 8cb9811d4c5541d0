"""Transactional versioned tables over plain Parquet files."""

from sparklake.table.merge import Merge
from sparklake.table.table import VersionedTable

__all__ = ["Merge", "VersionedTable"]
