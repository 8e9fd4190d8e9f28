"""Sources, sinks and row addresses."""

from .tables import (
    attach_clean_values, cell_value, from_tuples, read_submissions, read_table, with_row_id, write_table,
)

__all__ = [
    "attach_clean_values", "cell_value", "from_tuples", "read_submissions", "read_table", "with_row_id", "write_table",
]
