from .layout import write_bucketed
from .shared import shared_folder
from .snapshots import SNAPSHOT_SCHEMAS, land_snapshots, read_snapshots
from .tables import load_tables, rows_to_json, write_json_rows

__all__ = [
    "SNAPSHOT_SCHEMAS",
    "land_snapshots",
    "load_tables",
    "read_snapshots",
    "rows_to_json",
    "shared_folder",
    "write_bucketed",
    "write_json_rows",
]
