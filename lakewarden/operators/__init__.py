from .catalog import (
    list_objects,
    list_schemas,
    sequence_details,
    table_constraints,
    table_details,
)
from .health import (
    connection_health,
    health_report,
    index_hit_rate,
    replication_lag,
    replication_slots,
    sequence_discovery,
    sequence_headroom,
    table_hit_rate,
    unvalidated_constraints,
    wraparound_headroom,
)
from .incremental import classify_files, incremental_policy
from .indexes import (
    bloat_estimate,
    duplicate_indexes,
    index_bloat,
    index_inventory,
    invalid_indexes,
    unused_indexes,
)
from .integrity import (
    column_stats,
    key_headroom,
    validate_foreign_key,
    validate_not_null,
    validate_unique,
)
from .querylog import (
    classify_statements,
    counter_increments,
    counter_stats,
    mask_log_credentials,
    merge_moments,
    normalize_query_stats,
    query_stats,
    top_queries,
)
from .redact import (
    classify_columns,
    mask_columns,
    mask_policy,
    pii_columns,
    redact,
    redaction_verdicts,
)
from .text_scan import redact_text, scan_text

__all__ = [
    "bloat_estimate", "classify_columns", "classify_files", "classify_statements", "column_stats",
    "connection_health", "counter_increments", "counter_stats", "duplicate_indexes", "health_report", "index_bloat",
    "incremental_policy", "index_hit_rate", "index_inventory", "invalid_indexes", "key_headroom",
    "list_objects", "list_schemas", "mask_columns", "mask_log_credentials",
    "mask_policy", "merge_moments", "normalize_query_stats", "pii_columns", "query_stats", "redact",
    "redact_text", "redaction_verdicts", "replication_lag", "replication_slots",
    "scan_text", "sequence_details", "sequence_discovery", "sequence_headroom", "table_constraints",
    "table_details", "table_hit_rate", "top_queries", "unused_indexes",
    "unvalidated_constraints", "validate_foreign_key", "validate_not_null",
    "validate_unique", "wraparound_headroom",
]
