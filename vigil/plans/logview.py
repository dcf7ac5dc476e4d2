"""EVENT rows built from the driver's tables (the derived log view), and the tables stored from them.

``seq`` is the view's event id: the line ordinal, which tells equal lines apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.normalize import normalize
from vigil.plans.batch import detect_stored
from vigil.operators.store import append_events
from vigil.session import ensure_checkpoint_dir
from vigil.sources import derived
from vigil.sources.lines import clean_lines, event_id, parse_mixed


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auth lines with the auth parser, syslog lines with the syslog parser,
    in one pass (the view's source column picks the parser per line)."""
    lines = clean_lines(derived.log_lines(spark, sf_dir).withColumnRenamed("event_id", "seq"))
    both = parse_mixed(lines, "source", "value", year=derived.LOG_YEAR, now=derived.FALLBACK).drop("value")
    return both.withColumn("id", event_id(F.col("source"), F.lit("events"), F.col("raw"), F.col("seq")))


def view_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and normalised EVENT rows of the derived view (+ ``seq``)."""
    return normalize(parsed_events(spark, sf_dir))


_STORED: dict[tuple[str, str], tuple[str, str]] = {}


def stored_tables(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of the events table of the view and of the alerts that batch detection stores from it, in the shared
    folder; written by the first query of an application that asks."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        base = f"{ensure_checkpoint_dir(spark)}/vigil-{uuid.uuid4().hex}"
        append_events(spark, view_events(spark, sf_dir), f"{base}/events")
        detect_stored(spark, f"{base}/events", f"{base}/alerts")
        _STORED[key] = f"{base}/events", f"{base}/alerts"
    return _STORED[key]
