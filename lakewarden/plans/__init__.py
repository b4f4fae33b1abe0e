from .session import UnmaskedAccess, masked_session, run_masked, run_sql
from .statements import check_read_only

__all__ = ["UnmaskedAccess", "check_read_only", "masked_session", "run_masked", "run_sql"]
