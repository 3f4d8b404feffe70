"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_TIMES = ("timestamp", "time_start", "time_end")
_ARRAYS = ("mitre", "mitre_candidates", "attack_phases", "attack_phase_candidates", "detection_names", "ttp_flags", "tags", "related_event_ids")
# The columns of a timeline, in the order of its CSV form.
TIMELINE_COLUMNS = (
    "schema_version", "event_id", "timestamp", "timestamp_raw", "time_start", "time_end", "timezone", "timezone_confidence", "timestamp_type", "timestamp_precision", "timestamp_confidence",
    "host", "collection_id", "collection_name", "collection_input", "collection_host", "source_path", "source_sha256", "source_type", "parser", "parser_version", "evidence_role",
    "event_category", "event_action", "user", "uid", "gid", "src_ip", "dst_ip", "port", "process", "pid", "command", "file_path",
    "mitre", "mitre_candidates", "attack_phases", "attack_phase_candidates", "detection_names", "ttp_flags",
    "severity", "confidence", "tags", "related_event_ids", "summary", "raw", "extra",
)


def _kind(name: str) -> T.DataType:
    if name in _TIMES:
        return T.TimestampType()
    if name in _ARRAYS:
        return T.ArrayType(T.StringType())
    return T.MapType(T.StringType(), T.StringType()) if name == "extra" else T.StringType()


TIMELINE_SCHEMA = T.StructType([T.StructField(c, _kind(c)) for c in TIMELINE_COLUMNS])
LINES_SCHEMA = "source_path string, source_type string, collection_id string, line_no long, raw string"
IOC_SCHEMA = "value string, kind string, label string"
