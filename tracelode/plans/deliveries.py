"""Queries of problem 4: deliveries that came more than once."""

from __future__ import annotations

from tracelode.operators import delivery_index
from tracelode.session import table

_RANKED = """
SELECT *, row_number() OVER (
    PARTITION BY "teamId", trim("sessionId"), lower("contentSha256")
    ORDER BY try_cast("receivedAtUtc" AS TIMESTAMPTZ) ASC NULLS LAST, ingest_seq) AS copy_no
FROM trace_bundles
"""

QUERIES = {
    "p4_found": lambda spark, sf: delivery_index.surplus_deliveries(table(spark, sf, "trace_bundles")),
    "p4_kept": lambda spark, sf: delivery_index.kept_deliveries(table(spark, sf, "trace_bundles")).select("ingest_seq", "batchId", "teamId", "sessionId", "contentSha256", "receivedAtUtc"),
}

SQL = {
    "p4_found": f"SELECT ingest_seq FROM ({_RANKED}) AS r WHERE copy_no > 1",
    "p4_kept": f'SELECT ingest_seq, "batchId", "teamId", "sessionId", "contentSha256", "receivedAtUtc" FROM ({_RANKED}) AS r WHERE copy_no = 1',
}
