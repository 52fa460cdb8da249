"""Configuration objects. These are driver-side config (small), never data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Sequence

from pyspark.sql import DataFrame


def flag(value: Any) -> bool:
    """Load-metadata flags are 'Y'/'N' strings; blank or missing means 'N'."""
    if isinstance(value, bool):
        return value
    return str(value or "N").strip().upper() in ("Y", "YES", "TRUE", "1")


def names(value: Any) -> tuple[str, ...]:
    """A column list given as a comma-separated string or a sequence."""
    if value is None:
        return ()
    if isinstance(value, str):
        return tuple(v.strip() for v in value.split(",") if v.strip())
    return tuple(str(v).strip() for v in value if str(v).strip())


def order_spec(value: Any, default: str = "desc") -> tuple[tuple[str, str], ...]:
    """Order columns with an explicit direction per column (decision D1).

    Accepts ``"a desc, b"``, ``["a", ("b", "asc")]``. A column without a direction gets
    ``default``; a direction is never inherited from a neighbour.
    """
    if value is None:
        return ()
    items = value.split(",") if isinstance(value, str) else list(value)
    out = []
    for it in items:
        if isinstance(it, (tuple, list)):
            c, d = it[0], (it[1] if len(it) > 1 else default)
        else:
            parts = str(it).split()
            if not parts:
                continue
            c = parts[0]
            d = parts[1] if len(parts) > 1 else default
        d = str(d).lower()
        if d not in ("asc", "desc"):
            raise ValueError(f"order direction must be asc or desc, got {d!r} for {c}")
        out.append((str(c).strip(), d))
    return tuple(out)


@dataclass(frozen=True)
class AuditColumns:
    """Names of the six audit columns (configurable, decision D12).

    Types: system id INT, reporting unit INT, created time TIMESTAMP, created by STRING,
    updated time TIMESTAMP, updated by STRING.
    """

    system_id: str = "system_id"
    reporting_unit_id: str = "reporting_unit_id"
    created_time: str = "created_time"
    created_by: str = "created_by"
    updated_time: str = "updated_time"
    updated_by: str = "updated_by"

    def all(self) -> tuple[str, ...]:
        return (self.system_id, self.reporting_unit_id, self.created_time,
                self.created_by, self.updated_time, self.updated_by)

    def types(self) -> dict[str, str]:
        return {self.system_id: "int", self.reporting_unit_id: "int",
                self.created_time: "timestamp", self.created_by: "string",
                self.updated_time: "timestamp", self.updated_by: "string"}


@dataclass(frozen=True)
class ColumnMapping:
    """One target column of a source-to-target mapping.

    ``sources`` beyond the first feed the same target column (first non-null wins, JN-4);
    give them as extra ``ColumnMapping`` objects with the same target via ``alternates``.
    """

    target: str
    target_type: str = "string"
    source_field: str | None = None
    source_table: str | None = None
    source_type: str | None = None
    transformation: str = ""
    default: str | None = None
    source_format: str | None = None
    join_condition: str | None = None
    filter: str | None = None
    alternates: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lookup:
    """A reference table joined onto the main frame (JN-2)."""

    df: DataFrame
    on: Any  # column name(s) shared by both sides, or a Column condition
    columns: Sequence[str] = ()
    how: str = "left"
    name: str = "lookup"


@dataclass(frozen=True)
class LoadSpec:
    """Load metadata for one target table (keys only from here, decision D10)."""

    target_table: str
    merge_key: tuple[str, ...] = ()
    partition_columns: tuple[str, ...] = ()
    merge_type: str = "upsert"
    source_deduplication: bool = False
    stale_data_handling: bool = False
    source_partition_by: tuple[str, ...] = ()
    source_order_by: tuple[tuple[str, str], ...] = ()
    target_join_columns: tuple[str, ...] = ()
    target_audit_column: str | None = None
    order_by: tuple[tuple[str, str], ...] = ()
    audit: AuditColumns = field(default_factory=AuditColumns)

    @classmethod
    def from_metadata(cls, target_table: str, meta: dict, audit: AuditColumns | None = None,
                      order_by: Any = None) -> "LoadSpec":
        """Build from the string metadata of a mapping (all values are strings)."""
        audit_cols = names(meta.get("target_audit_columns"))
        if len(audit_cols) > 1:
            raise ValueError(f"{target_table}: the stale rule compares one column, "
                             f"target_audit_columns names {list(audit_cols)}")
        return cls(
            target_table=target_table,
            merge_key=names(meta.get("merge_key")),
            partition_columns=names(meta.get("partition_columns")),
            merge_type=(meta.get("merge_type") or "upsert").strip().lower(),
            source_deduplication=flag(meta.get("source_deduplication")),
            stale_data_handling=flag(meta.get("stale_data_handling")),
            source_partition_by=names(meta.get("source_partitionBy_columns")),
            source_order_by=order_spec(meta.get("source_orderBy_columns")),
            target_join_columns=names(meta.get("target_join_columns")),
            target_audit_column=audit_cols[0] if audit_cols else None,
            order_by=order_spec(order_by),
            audit=audit or AuditColumns(),
        )


@dataclass(frozen=True)
class TargetSpec:
    """One silver target fed from a shared bronze frame (fan-out, SNK-6)."""

    load: LoadSpec
    mappings: tuple[ColumnMapping, ...]
    audit_passthrough: bool = True
