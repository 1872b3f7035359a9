"""Sources and sinks."""

from .fixtures import events_readings, events_scores
from .readers import READING_SCHEMA, long_readings, read_table, read_tag, read_tags
from .sinks import create_namespace, overwrite_partitions, table_extent, with_year, write_table

__all__ = [
    "events_readings", "events_scores", "READING_SCHEMA", "long_readings",
    "read_table", "read_tag", "read_tags", "create_namespace", "overwrite_partitions", "table_extent",
    "with_year", "write_table",
]
