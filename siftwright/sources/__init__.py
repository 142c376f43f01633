from .scratch import checkpoint_root, materialize, scratch_path
from .sinks import (
    REGISTER_COLUMNS, assert_unique_key, duplicate_keys, write_register, write_scores,
    write_summary, write_table,
)
from .tables import (
    ENTITY_CSV, LABEL_CSV, PANEL_CSV, Tables, nan_to_null, read_csv_table, read_summary,
)

__all__ = [
    "ENTITY_CSV", "LABEL_CSV", "PANEL_CSV", "REGISTER_COLUMNS", "Tables", "assert_unique_key",
    "checkpoint_root", "duplicate_keys", "materialize", "nan_to_null", "read_csv_table",
    "read_summary", "scratch_path", "write_register", "write_scores", "write_summary",
    "write_table",
]
