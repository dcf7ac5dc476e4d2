"""Batch detection over the stored events table (P2) and its summary (P3)."""

from __future__ import annotations

import logging
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from vigil.operators.builtin import builtin_rules
from vigil.operators.detect import detect
from vigil.operators.query import newest_first
from vigil.operators.rules import Rule, load_rules_dir
from vigil.operators.sinks import Sink, fan_out
from vigil.operators.store import append_alerts, read_events
from vigil.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)


def rules_for(rules_dir: str | None) -> list[Rule]:
    """Rules of a folder when it exists, else the built-in ones."""
    if rules_dir and Path(rules_dir).is_dir():
        return load_rules_dir(rules_dir)
    log.info("rules folder %r not found, using built-in rules", rules_dir)
    return builtin_rules()


def detect_stored(spark: SparkSession, events_path: str, alerts_path: str, rules_dir: str | None = None,
                  newest: int | None = None, sinks: list[Sink] | None = None) -> dict:
    """Detect on stored events (no re-normalisation), store the alerts, send
    them to the sinks (no dedup in batch), return counts.

    ``newest`` caps the run to the newest N events when asked; by default the
    whole table is used."""
    events = read_events(spark, events_path)
    if newest:
        events = newest_first(events, limit=newest)
    rules = rules_for(rules_dir)
    alerts = detect(events, rules)
    if sinks:  # detected once: the table and every sink read the run's alerts from the shared folder
        path = f"{ensure_checkpoint_dir(spark)}/detected-{uuid.uuid4().hex}"
        alerts.write.parquet(path)
        alerts = spark.read.schema(alerts.schema).parquet(path)
        fan_out(alerts, 0, sinks, persist=False)
    n_alerts = append_alerts(spark, alerts, alerts_path)
    return {"rules": len(rules), "events": events.count(), "alerts": n_alerts}
