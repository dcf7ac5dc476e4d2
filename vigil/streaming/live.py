"""Follow-mode sources (A4) and the live pipeline (P1) on Structured Streaming.

The stored events table is the one place where events get their ids, so batch, live events and live alerts agree:

* events: new files -> ``foreachBatch``: equal lines of a file are numbered (the file source hands a file to one
  micro-batch whole), parsed, normalised and appended idempotently (a replayed batch adds nothing). Events without a
  message go to the quarantine table.
* alerts: the events table, read as a stream -> plain rules (no state) and threshold rules (state per rule and key) ->
  ``foreachBatch``: every alert is stored, before dedup, as the reference does. An event that arrives later than the
  watermark still raises its plain alerts; only threshold state no longer counts it.
* dispatch (with sinks): the same alerts -> dedup state (per rule, source, host) -> ``foreachBatch``: the dispatched ones
  are joined with their stored events and fanned out to the sinks. No event passes through state.

Every source has its own events query: one that fails at run time does not stop the others. ``live_source`` picks up
new files of a folder; ``appended_source`` follows the lines appended to files, from their ends on unless told otherwise.
"""

from __future__ import annotations

import datetime as _dt
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions.timeparse import now_literal
from vigil.operators.builtin import builtin_rules
from vigil.operators.detect import _plan, _rule_meta, alert_id, plain_hits
from vigil.operators.normalize import normalize, split_valid
from vigil.operators.rules import Rule
from vigil.operators.sinks import Sink, fan_out
from vigil.operators.store import append_alerts, append_events, event_text, from_stored_events, read_events, stored_schema
from vigil.schema import EVENT_COLUMNS, EVENT_TABLE, STORED_ALERT
from vigil.sources.appended import SPLIT, follow_appended, placed_lines
from vigil.sources.lines import clean_lines, numbered_lines, parse_auth, parse_syslog
from vigil.sources.ndjson import parse_ndjson
from vigil.streaming.stateful import observe_stats, stream_dedup, stream_threshold

log = logging.getLogger(__name__)

_PARSERS = {"syslog": parse_syslog, "auth": parse_auth, "json": parse_ndjson}


def follow_lines(spark: SparkSession, path: str, start_time: _dt.datetime | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of (value, file_path) from new text files under ``path``.

    ``start_time``: only files modified at or after it (the reference starts
    at the end of the file, i.e. only data that arrives after start)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(path).select("value", F.col("_metadata.file_path").alias("file_path"),
                             F.col("_metadata.file_modification_time").alias("_mtime"))
    if start_time is not None:
        df = df.filter(F.col("_mtime") >= now_literal(start_time))
    return clean_lines(df.drop("_mtime"))


def follow(spark: SparkSession, path: str, kind: str = "syslog", name: str | None = None,
           start_time: _dt.datetime | None = None, max_files_per_trigger: int | None = None, **parse_args) -> DataFrame:
    """Stream of parsed events without ids, for counting and filtering on the fly; ids are given where
    events are stored (``start_live``)."""
    lines = follow_lines(spark, path, start_time, max_files_per_trigger)
    return _PARSERS[kind](lines, "value", name or kind, **parse_args).drop("value")


@dataclass
class LiveSource:
    """A collector of the live pipeline: its line stream, and how a micro-batch of lines becomes events with ids."""

    name: str
    lines: DataFrame
    events: Callable[[DataFrame], DataFrame]


def live_source(spark: SparkSession, path: str, kind: str = "syslog", name: str | None = None,
                start_time: _dt.datetime | None = None, max_files_per_trigger: int | None = None, **parse_args) -> LiveSource:
    name = name or kind

    def events(lines: DataFrame) -> DataFrame:
        return _PARSERS[kind](numbered_lines(lines, name), "value", name, **parse_args).drop("value")

    return LiveSource(name, follow_lines(spark, path, start_time, max_files_per_trigger), events)


def appended_source(spark: SparkSession, path: str, kind: str = "syslog", name: str | None = None, start: str = "end",
                    split_bytes: int = SPLIT, **parse_args) -> LiveSource:
    """A source whose files (a file, a folder or a pattern) grow: every complete line appended arrives once."""
    name = name or kind

    def events(lines: DataFrame) -> DataFrame:
        return _PARSERS[kind](placed_lines(lines, name), "value", name, **parse_args).drop("value")

    return LiveSource(name, follow_appended(spark, path, start, split_bytes), events)


def stream_stored_events(spark: SparkSession, events_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream of EVENT rows, in the order in which its files were added."""
    r = spark.readStream.schema(stored_schema(EVENT_TABLE))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return from_stored_events(r.parquet(events_path))


def stream_alerts(events: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """Event stream (with watermark and ids) -> narrow alert stream: the alert's own columns, the event's id, source and
    host, and ``keep`` columns of the event. Plain rules are a projection; only matches of threshold rules go through
    state, without their events: those are joined back by id where they are needed (``with_event``)."""
    plan = _plan(rules)
    ev = events.select("*", *[c.alias(k) for k, c in plan.helpers.items()])
    columns = ["id", "timestamp", "source", "hostname", "rule_ord", "match_count", *keep]
    parts = []
    if plan.plain:
        parts.append(plain_hits(ev, plan).select(*columns))
    if plan.by_window:
        found = F.filter(F.array(*[
            F.when(s.match, F.struct(F.lit(o).alias("o"), s.key.cast("string").alias("k"), F.lit(s.need).alias("n"), F.lit(w).cast("long").alias("w")))
            for w, own in plan.by_window.items() for o, s in own]), lambda x: x.isNotNull())
        x = ev.select("*", F.explode(found).alias("_hit")).select(
            *[c for c in columns if c not in ("rule_ord", "match_count")], F.col("_hit.o").alias("rule_ord"),
            F.col("_hit.k").alias("group_key"), F.col("_hit.n").alias("th_need"), F.col("_hit.w").alias("th_window"))
        parts.append(stream_threshold(x, "id").select(*columns))
    th = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    meta = _rule_meta(rules, F.col("rule_ord"))
    return th.select(
        alert_id(meta["rule_id"], meta["rule_name"], F.col("id")).alias("id"),
        meta["rule_id"].alias("rule_id"), meta["rule_name"].alias("rule_name"),
        meta["severity"].alias("severity"), F.col("id").alias("event_id"), F.col("timestamp"),
        meta["description"].alias("description"), "rule_ord", "match_count", "source", "hostname", *keep,
    )


def start_live(spark: SparkSession, sources: list[LiveSource], events_path: str, alerts_path: str,
               checkpoint_root: str, sinks: list[Sink] | None = None, rules: list[Rule] | None = None,
               dedup_window_s: float = 300, watermark: str = "10 minutes",
               trigger_seconds: float = 10.0, quarantine_path: str | None = None) -> list[StreamingQuery]:
    """Start the live pipeline: one events query for each source, the alerts query over the events table and, with
    sinks, the dispatch query."""
    return (start_events(spark, sources, events_path, checkpoint_root, trigger_seconds, quarantine_path)
            + start_alerts(spark, events_path, alerts_path, checkpoint_root, sinks, rules, dedup_window_s, watermark, trigger_seconds))


def _make_table(spark: SparkSession, path: str, schema) -> None:
    spark.createDataFrame([], stored_schema(schema)).write.mode("append").partitionBy("event_date").parquet(path)


def start_events(spark: SparkSession, sources: list[LiveSource], events_path: str, checkpoint_root: str,
                 trigger_seconds: float = 10.0, quarantine_path: str | None = None) -> list[StreamingQuery]:
    """The queries that store events, one for each source.

    Events that lack what the table needs (a message) are written under ``quarantine_path`` as JSON lines, by source
    (default: ``<events_path>_quarantine``), never dropped."""
    quarantine = quarantine_path or events_path.rstrip("/") + "_quarantine"
    _make_table(spark, events_path, EVENT_TABLE)

    def start_source(source: LiveSource) -> StreamingQuery:
        def store(lines: DataFrame, batch_id: int) -> None:
            events = normalize(source.events(lines)).persist()
            try:
                good, bad = split_valid(events)
                # a folder for each source: queries that write at one time to one folder clear each other's uncommitted files
                bad.select(event_text().alias("value")).write.mode("append").text(f"{quarantine}/source={source.name}")
                dates = [r[0] for r in good.select(F.to_date("timestamp")).distinct().collect()]
                append_events(good.sparkSession, good, events_path, dates)
            finally:
                events.unpersist()

        return (source.lines.writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint_root}/events-{source.name}")
                .trigger(processingTime=f"{trigger_seconds} seconds").queryName(f"vigil_events_{source.name}").start())

    return [start_source(s) for s in sources]


def start_alerts(spark: SparkSession, events_path: str, alerts_path: str, checkpoint_root: str, sinks: list[Sink] | None = None,
                 rules: list[Rule] | None = None, dedup_window_s: float = 300, watermark: str = "10 minutes",
                 trigger_seconds: float = 10.0) -> list[StreamingQuery]:
    """The queries over the events table: alerts are stored and, with sinks, the dispatched ones sent out."""
    rules = rules if rules is not None else builtin_rules()
    sinks = sinks or []
    trig = {"processingTime": f"{trigger_seconds} seconds"}
    _make_table(spark, alerts_path, STORED_ALERT)
    events = stream_stored_events(spark, events_path).withWatermark("timestamp", watermark)
    alerts = stream_alerts(events, rules)

    def store_alerts(df: DataFrame, batch_id: int) -> None:
        append_alerts(df.sparkSession, df, alerts_path)

    queries = [alerts.writeStream.foreachBatch(store_alerts).option("checkpointLocation", f"{checkpoint_root}/alerts")
               .trigger(**trig).queryName("vigil_alerts").start()]
    if sinks:
        flagged = observe_stats(stream_dedup(alerts, dedup_window_s), handlers=len(sinks))

        def dispatch(df: DataFrame, batch_id: int) -> None:
            fan_out(with_event(df.filter("dispatched"), read_events(df.sparkSession, events_path)), batch_id, sinks)

        queries.append(flagged.writeStream.foreachBatch(dispatch).option("checkpointLocation", f"{checkpoint_root}/dispatch")
                       .trigger(**trig).queryName("vigil_dispatch").start())
    return queries


def with_event(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alert rows with their stored events nested; the alert's time is its event's, so only the dates of these alerts are read."""
    stored = events.select(F.struct(*EVENT_COLUMNS).alias("event"), F.col("event_date").alias("_date"))
    return alerts.join(stored, (F.col("event_id") == F.col("event.id")) & (F.to_date("timestamp") == F.col("_date"))).drop("_date")


def stream_events_per_hour(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Events per hour on a stream: event-time tumbling windows of 1 hour,
    closed by the watermark (H10 stream form)."""
    return (events.withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:00").alias("hour"), "count"))


def upsert_hours(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the hours that a micro-batch changed, open ones included, to ``path/batch=N``: a replayed batch overwrites what it
    wrote. The query runs in update mode, so hours that the watermark has closed leave its state."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()


def read_hours(spark: SparkSession, path: str) -> DataFrame:
    """(hour, count): the last count written of every hour."""
    rows = spark.read.schema("hour string, count long, batch long").parquet(path)
    return rows.groupBy("hour").agg(F.max_by("count", "batch").alias("count"))


def to_end(queries: list[StreamingQuery]) -> None:
    """Let queries process what is there, one after the other, and stop them."""
    try:
        for q in queries:
            q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()


def run_to_end(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming DataFrame over everything available now into a Parquet
    folder under the shared checkpoint folder; return that folder as a batch
    DataFrame. A fresh subfolder per run keeps runs apart; the platform clears the shared folder."""
    import uuid

    from vigil.session import ensure_checkpoint_dir
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.option("checkpointLocation", f"{base}/ck").trigger(availableNow=True)
         .format("parquet").option("path", f"{base}/out").start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(df.schema).parquet(f"{base}/out")
