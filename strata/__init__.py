"""strata: mapping-driven bronze -> silver -> gold loads as Spark DataFrame plans.

A source-to-target mapping (data, not code) becomes projections, casts, the glossary of
standard transformations, filters, joins and lookups. Around that core sit latest-record
deduplication, stale-data exclusion, upsert, slice overwrite and publish loads with an
audit trail, one-pass data-quality rules, emissions calculations, and set-based checks
over whole collections of mappings and texts. Every row-level step is a Spark SQL
expression or DataFrame transform; there are no Python UDFs.
"""

from strata.spec import AuditColumns, ColumnMapping, LoadSpec, Lookup, TargetSpec

__all__ = ["AuditColumns", "ColumnMapping", "LoadSpec", "Lookup", "TargetSpec"]
