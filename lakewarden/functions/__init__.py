from .detectors import (
    DETECTORS,
    Detector,
    detect,
    is_json_document,
    is_pii_name,
    json_has_pii_key,
    name_is_pii,
    should_redact,
    value_is_pii,
    vector_detector,
)
from .fixed_values import PII_KEYWORDS, REDACTED
from .text import mask_credentials

__all__ = [
    "DETECTORS",
    "Detector",
    "PII_KEYWORDS",
    "REDACTED",
    "detect",
    "is_json_document",
    "is_pii_name",
    "json_has_pii_key",
    "mask_credentials",
    "name_is_pii",
    "should_redact",
    "value_is_pii",
    "vector_detector",
]
