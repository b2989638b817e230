"""Queries of problem 5: schemas that drift between files."""

from __future__ import annotations

from tracelode.operators import schema_drift
from tracelode.session import table

QUERIES = {
    "p5_found": lambda spark, sf: schema_drift.schema_changes(table(spark, sf, "raw_trace_records")),
    "p5_events": lambda spark, sf: schema_drift.consistent_events(table(spark, sf, "raw_trace_records")),
}

SQL: dict[str, str] = {}
