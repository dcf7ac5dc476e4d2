"""Event and alert schemas, severity values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (must equal the reference): severity names and the text forms
# that parse to them; anything else parses to "low".
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_ALIASES = {
    "low": "low",
    "informational": "low",
    "info": "low",
    "medium": "medium",
    "high": "high",
    "critical": "critical",
}

GEO_ENTRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("country", T.StringType()),
])

EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("parsed_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ip_addresses", T.ArrayType(T.StringType())),
    T.StructField("geo", T.MapType(T.StringType(), GEO_ENTRY)),
])

EVENT_COLUMNS = [f.name for f in EVENT.fields]

ALERT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("event", EVENT),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("description", T.StringType()),
])

# Stored tables: the nested dictionary is kept as JSON text, as the
# reference's tables do, and rows are partitioned by event date.
STORED_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw_json", T.StringType()),
    T.StructField("parsed_json", T.StringType()),
])

# The events table holds, beside that text, the parsed fields as typed columns, so that scans decode no JSON.
EVENT_TABLE = T.StructType(STORED_EVENT.fields + [f for f in EVENT.fields if f.name in ("parsed_fields", "ip_addresses", "geo")])

STORED_ALERT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("description", T.StringType()),
])

# Columns that the stored tables require.
EVENT_NOT_NULL = ("id", "timestamp", "source", "hostname", "severity", "message")
ALERT_NOT_NULL = ("id", "rule_id", "rule_name", "severity", "timestamp")
