"""Alert outputs: JSON lines file, console records, delivery outbox, fan-out.

Each sink is a plain ``(DataFrame, batch_id) -> None`` function, so the same
code serves a batch job and a streaming ``foreachBatch``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.store import event_text, iso_time

log = logging.getLogger(__name__)

Sink = Callable[[DataFrame, int], None]


def alert_json(alerts: DataFrame) -> DataFrame:
    """One JSON object per alert, event nested (``value`` column)."""
    head = F.to_json(F.struct("id", "rule_id", "rule_name", "severity"), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct(iso_time(F.col("timestamp")).alias("timestamp"), "description"), {"ignoreNullFields": "false"})
    event = event_text(lambda name: F.col(f"event.{name}"))
    return alerts.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"event":'), event, F.lit(","),
                                  F.regexp_replace(tail, r"^\{", "")).alias("value"))


def console_records(alerts: DataFrame) -> DataFrame:
    """The fields an operator reads on the console, one row per alert."""
    return alerts.select(
        F.col("rule_name"),
        F.upper(F.col("severity")).alias("severity"),
        F.col("description"),
        F.substring(F.col("event.message"), 1, 200).alias("event"),
        F.concat_ws(" @ ", F.col("event.source"), F.col("event.hostname")).alias("source"),
        iso_time(F.col("timestamp")).alias("time"),
    )


def file_sink(path: str) -> Sink:
    """Append alerts as JSON lines under ``path`` (one file per task)."""
    def write(df: DataFrame, batch_id: int) -> None:
        alert_json(df).write.mode("append").text(path)
    return write


def outbox_sink(path: str, url: str, headers: dict | None = None) -> Sink:
    """Delivery payloads (whole alert JSON) for a web hook, written to an
    outbox table; a separate sender posts them. No HTTP client here."""
    hdrs = headers or {"Content-Type": "application/json"}
    def write(df: DataFrame, batch_id: int) -> None:
        (alert_json(df).select(
            F.lit(url).alias("url"),
            F.to_json(F.create_map(*[x for kv in hdrs.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])).alias("headers"),
            F.col("value").alias("payload"),
            F.lit(batch_id).alias("batch_id"))
         .write.mode("append").parquet(path))
    return write


def console_sink(emit: Callable[[str], None] = print) -> Sink:
    """Every alert of the batch as one line of text; rows reach the driver partition by partition, never all at once."""
    def write(df: DataFrame, batch_id: int) -> None:
        line = F.concat_ws(" | ", "time", "severity", "rule_name", "source", "event", "description")
        for row in console_records(df).select(line.alias("line")).toLocalIterator():
            emit(row["line"])
    return write


def fan_out(alerts: DataFrame, batch_id: int, sinks: list[Sink], persist: bool = True) -> dict:
    """Send one batch of dispatched alerts to every sink; a failing sink is
    logged and does not stop the others. A micro-batch is computed once (``persist``); rows that are read from a
    table need not be."""
    alerts = alerts.persist() if persist else alerts
    failed = 0
    try:
        for sink in sinks:
            try:
                sink(alerts, batch_id)
            except Exception:  # noqa: BLE001
                failed += 1
                log.exception("alert sink %r failed on batch %s", sink, batch_id)
    finally:
        if persist:
            alerts.unpersist()
    return {"sinks": len(sinks), "failed": failed}
