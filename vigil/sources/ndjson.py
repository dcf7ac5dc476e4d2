"""Newline-delimited JSON lines -> EVENT rows, with a key -> field map.

Lines are read as text and decoded with ``from_json`` into a
``map<string,string>`` (nested values stay JSON text), so one projection does
the work and the original line is kept as ``raw``. Lines that are not a JSON
object decode to NULL and are dropped.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.partitioning import generated
from vigil.functions.text import map_present, parse_severity
from vigil.functions.timeparse import json_time
from vigil.sources.lines import numbered_lines, read_text_lines

# Fixed value (must equal the reference): default JSON key -> event field
# map, in its lookup order (the first present key wins for each field).
DEFAULT_FIELD_MAP = {
    "timestamp": "timestamp",
    "time": "timestamp",
    "@timestamp": "timestamp",
    "host": "hostname",
    "hostname": "hostname",
    "source": "source",
    "level": "severity",
    "severity": "severity",
    "msg": "message",
    "message": "message",
}


def mapped_fields(m: Column, field_map: dict | None) -> dict[str, tuple[Column, Column]]:
    """target -> (present?, value) where value comes from the first JSON key
    of the map (in map order) that is present in the object, NULL included."""
    fmap = field_map or DEFAULT_FIELD_MAP
    by_target: dict[str, list[str]] = {}
    for key, target in fmap.items():
        by_target.setdefault(target, []).append(key)
    out = {}
    for target, keys in by_target.items():
        present = reduce(lambda a, b: a | b, [map_present(m, k) for k in keys])
        value = None
        for k in keys:
            value = (F.when(map_present(m, k), m[k]) if value is None
                     else value.when(map_present(m, k), m[k]))
        out[target] = (present, value)
    return out


def parse_ndjson(df: DataFrame, line: str = "value", source: str = "json", field_map: dict | None = None,
                 now: _dt.datetime | None = None) -> DataFrame:
    """JSON lines -> events; other columns of ``df`` are kept."""
    # The parsed map is an explode output: non-objects vanish, and later
    # filters on JSON fields cannot re-run the parse.
    d = df.withColumn("_m_all", F.from_json(F.col(line), "map<string,string>"))
    d = generated(d, "_m_all", F.col("_m_all").isNotNull(), "_m")
    m = F.col("_m")
    f = mapped_fields(m, field_map)
    none = (F.lit(False), F.lit(None).cast("string"))
    ts_p, ts_v = f.get("timestamp", none)
    sv_p, sv_v = f.get("severity", none)
    src_p, src_v = f.get("source", none)
    host_p, host_v = f.get("hostname", none)
    msg_p, msg_v = f.get("message", none)
    return d.select(
        "*",
        json_time(ts_v, now).alias("timestamp"),
        F.when(src_p, src_v).otherwise(F.lit(source)).alias("source"),
        F.when(host_p, host_v).otherwise(F.lit("unknown")).alias("hostname"),
        parse_severity(sv_v).alias("severity"),
        # Without a message key the whole object is the message: the line's
        # JSON text is used (the reference re-serialises the object).
        F.when(msg_p, msg_v).otherwise(F.col(line)).alias("message"),
        F.col(line).alias("raw"),
        m.alias("parsed_fields"),
    ).drop("_m")


def read_ndjson(spark: SparkSession, path, name: str = "json", field_map: dict | None = None,
                now: _dt.datetime | None = None) -> DataFrame:
    """Batch NDJSON source: whole files -> events with ids."""
    return parse_ndjson(numbered_lines(read_text_lines(spark, path), name), "value", name, field_map, now).drop("value")
