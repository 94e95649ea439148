"""Readers and writers."""

from epistrand.sources.files import (  # noqa: F401
    read_csv_checked,
    read_csv_lenient,
    read_csv_strict,
    read_csv_strings,
    read_events,
    read_tsv,
    rebuild_partitions,
    reject_counts,
    use_binary_as_string,
    write_bucketed,
    write_csv,
    write_parquet,
)
from epistrand.sources.logs import append_log, read_log  # noqa: F401
from epistrand.sources.keyed import drop_stored, store_by_key  # noqa: F401
from epistrand.sources.longrows import join_segments, write_long_rows  # noqa: F401
from epistrand.sources.store import local_table, materialize, name_relation, release, scoped_tables  # noqa: F401
