"""The registered queries, by family."""

from sparklake.plans import aggregation, functions, joins, libraries, projection, sets, sources, streams, surface, tables, udfs, windows

REGISTRIES = tuple(m.QUERIES for m in (sources, projection, joins, aggregation, windows, sets, functions, udfs, tables, libraries, streams, surface))
