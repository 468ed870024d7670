"""Readers: labelled text (CSV / parquet), split tables, metric records, run history."""

from .labelled import (  # noqa: F401
    check_required,
    freeze_row_ids,
    read_labelled_csv,
    read_labelled_parquet,
    read_split,
)
from .records import (  # noqa: F401
    METRICS_SCHEMA,
    read_keyed_csv,
    read_metrics,
    read_run_history,
    read_table_csv,
)
