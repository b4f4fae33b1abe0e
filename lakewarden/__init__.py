"""Safe access to data and to the databases it comes from, on Spark."""

from .functions import DETECTORS, PII_KEYWORDS, REDACTED, Detector, vector_detector
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import UnmaskedAccess, check_read_only, masked_session, run_masked, run_sql
from .sources import (
    land_snapshots,
    load_tables,
    read_snapshots,
    rows_to_json,
    write_bucketed,
    write_json_rows,
)
from .streaming import redact_stream, run_masked_stream, scan_stream

__all__ = [
    "DETECTORS", "Detector", "PII_KEYWORDS", "REDACTED", "UnmaskedAccess", "check_read_only",
    "land_snapshots", "load_tables", "masked_session", "read_snapshots", "redact_stream", "rows_to_json",
    "run_masked", "run_masked_stream", "run_sql", "scan_stream", "vector_detector", "write_bucketed", "write_json_rows", *_operators,
]
