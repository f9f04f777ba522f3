"""What this engine can do, and its default limits."""

from __future__ import annotations

from .operators.scan import ScanRequest
from .plans.sql import QUERY_BYTES, TOTAL_BYTES
from .sources.store import AUTO_COMPACT, FORMAT, RETAINED, WriteLimits


def capabilities() -> dict:
    request, limits = ScanRequest(), WriteLimits()
    return {
        "format": FORMAT,
        "features": {k: True for k in ("structured_scan", "sql", "snapshots", "time_travel", "erasure", "refold", "compaction", "verify", "streaming_ingest", "jsonl_import", "otel_import")}
        | {k: False for k in ("byte_container", "browser", "format_migration")},
        "limits": {
            "limit": request.limit,
            "max_examined": request.max_examined,
            "max_resolution_entries": request.max_resolution_entries,
            "max_reconstructed_bytes": request.max_reconstructed_bytes,
            "max_record_bytes": limits.max_record_bytes,
            "max_batch_bytes": limits.max_batch_bytes,
            "max_batch_records": limits.max_batch_records,
            "max_identifier_bytes": limits.max_identifier_bytes,
            "sql_query_bytes": QUERY_BYTES,
            "sql_total_bytes": TOTAL_BYTES,
            "retained_commits": RETAINED,
            "auto_compact_parts": AUTO_COMPACT,
        },
    }
