from .masked_stream import run_masked_stream
from .redact_stream import redact_stream
from .scan_stream import scan_stream

__all__ = ["redact_stream", "run_masked_stream", "scan_stream"]
