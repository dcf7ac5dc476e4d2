"""Events / alerts tables: idempotent appends, scans, JSON (de)serialisation.

Tables are Parquet, partitioned by ``event_date``. Ids are deterministic and
an event's id determines its time, so a duplicate can only sit in the same
date partition. An append is one exchange: rows and the ids stored already meet by
date and slice of a date, each id is told once there, and the same tasks write
the date's files. Events are stored with the JSON text of their
parsed fields and, decoded once when written, with typed columns that scans read.
"""

from __future__ import annotations

import datetime as _dt
import threading

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vigil.functions.partitioning import generated
from vigil.schema import ALERT_NOT_NULL, EVENT_COLUMNS, EVENT_NOT_NULL, EVENT_TABLE, GEO_ENTRY, STORED_ALERT
from pyspark.sql import types as T



def iso_time(ts: Column) -> Column:
    """Python ``isoformat()`` of a UTC instant: fraction only when non-zero."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    body = F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.concat(body, F.lit("+00:00"))


def parsed_json(pf: Column, ips: Column, geo: Column) -> Column:
    """One JSON object: the parsed fields plus ``ip_addresses`` and ``geo``.

    The two lists replace parsed fields of the same name (as the reference's dictionary does when the event is
    normalised); where there is no list, a parsed field of that name stays."""
    own = F.map_filter(pf, lambda k, v: ~((k == "ip_addresses") & ips.isNotNull()) & ~((k == "geo") & geo.isNotNull()))
    inner = F.nullif(F.regexp_replace(F.coalesce(F.to_json(own), F.lit("{}")), r"^\{|\}$", ""), F.lit(""))
    return F.concat(
        F.lit("{"),
        F.concat_ws(",", inner,
                    F.when(ips.isNotNull(), F.concat(F.lit('"ip_addresses":'), F.to_json(ips))),
                    F.when(geo.isNotNull(), F.concat(F.lit('"geo":'), F.to_json(geo)))),
        F.lit("}"),
    )


def to_stored_events(events: DataFrame, keep: tuple[str, ...] = (), date: Column | None = None) -> DataFrame:
    """EVENT rows -> rows of the events table (+ ``event_date`` partition column, ``date`` where it is known)."""
    return events.select(*keep,
        "id", "timestamp", "source", "hostname", "severity", "message",
        F.col("raw").alias("raw_json"),
        parsed_json(F.col("parsed_fields"), F.col("ip_addresses"), F.col("geo")).alias("parsed_json"),
        *typed_columns(F.col("parsed_fields"), F.col("ip_addresses"), F.col("geo")),
        (F.to_date("timestamp") if date is None else date).alias("event_date"),
    )


def from_stored_events(stored: DataFrame, keep: tuple[str, ...] = (), decode_text: bool = False) -> DataFrame:
    """Stored rows -> EVENT rows, from the typed columns; with ``decode_text`` from the JSON text (NULL or empty text
    gives an empty map), for tables that hold nothing else."""
    parsed = parsed_columns(F.col("parsed_json")) if decode_text else ["parsed_fields", "ip_addresses", "geo"]
    return stored.select(*keep,
        "id", "timestamp", "source", "hostname", "severity", "message",
        F.col("raw_json").alias("raw"), *parsed)


def parsed_columns(text: Column) -> list[Column]:
    """``parsed_fields``, ``ip_addresses`` and ``geo`` of a parsed-fields JSON object."""
    return typed_columns(F.from_json(F.nullif(text, F.lit("")), "map<string,string>"))


def typed_columns(fields: Column, ip_addresses: Column | None = None, geo: Column | None = None) -> list[Column]:
    """``parsed_fields``, ``ip_addresses`` and ``geo`` as they are read back from a stored event. Without a list beside
    the fields, a key of the two names that holds such a list's text is that list; else it is a field like any other."""
    m = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    ips = F.when(F.startswith(m["ip_addresses"], F.lit("[")), F.from_json(m["ip_addresses"], T.ArrayType(T.StringType())))
    places = F.when(F.startswith(m["geo"], F.lit("{")), F.from_json(m["geo"], T.MapType(T.StringType(), GEO_ENTRY)))
    ips = ips if ip_addresses is None else F.coalesce(ip_addresses, ips)
    places = places if geo is None else F.coalesce(geo, places)
    own = F.map_filter(m, lambda k, v: ~((k == "ip_addresses") & ips.isNotNull()) & ~((k == "geo") & places.isNotNull()))
    return [own.alias("parsed_fields"), ips.alias("ip_addresses"), places.alias("geo")]


def to_stored_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(*[f.name for f in STORED_ALERT.fields], F.to_date("timestamp").alias("event_date"))


def first_wins(df: DataFrame, order: str | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per ``keys``: the first by ``order`` (any one when None).

    An aggregation, so duplicates collapse map-side before the shuffle.
    """
    cols = [c for c in df.columns if c not in keys]
    if not cols:
        return df.distinct()
    row = F.struct(*[F.col(c) for c in cols])
    pick = F.min_by(row, F.col(order)) if order else F.first(row)
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def new_rows(incoming: DataFrame, existing: DataFrame | None, not_null=EVENT_NOT_NULL,
             order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` an idempotent insert would add: rows with NULL in
    a required column are skipped, the first copy of an id wins, ids already
    stored are left alone."""
    ok = incoming
    for c in not_null:
        ok = ok.filter(F.col(c).isNotNull())
    # The id fixes the event date, so (id, event_date) groups like id alone;
    # grouping on both leaves the rows partitioned the way the anti-join
    # below needs them (one shuffle), and lets it prune stored dates.
    with_date = "event_date" in ok.columns and (existing is None or "event_date" in existing.columns)
    keys = ["id", "event_date"] if with_date else ["id"]
    ok = first_wins(ok, order, tuple(keys))
    if existing is None:
        return ok
    return ok.join(existing.select(*keys), keys, "left_anti")


def _stored_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The stored rows with their known schema (no file is opened to infer it), or None before the first append."""
    try:
        return spark.read.schema(stored_schema(schema)).parquet(path)
    except AnalysisException:
        return None


_WRITERS = threading.Lock()
SLICES = 8                # tasks that write a date's rows of one append, at most


def dealt_new_rows(incoming: DataFrame, existing: DataFrame | None, not_null) -> DataFrame:
    """``new_rows`` of rows with ``event_date`` in one exchange of whole rows, which deals them the way they are written: by date
    and slice of a date. Stored rows come along as bare ids, so they are joined without dealing the new ones again."""
    columns = incoming.columns
    for c in not_null:
        incoming = incoming.filter(F.col(c).isNotNull())
    row = F.struct(*[c for c in columns if c not in ("id", "event_date")])
    rows = incoming.select("id", "event_date", row.alias("_row"))
    if existing is not None:
        rows = rows.unionByName(existing.select("id", "event_date", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(SLICES))).repartition("event_date", "_slice")
    once = dealt.groupBy("event_date", "_slice", "id").agg(F.first("_row").alias("_row"), F.bool_or(F.col("_row").isNull()).alias("_known"))
    return once.where("not _known").select("id", "event_date", "_row.*").select(*columns)


def _append(spark: SparkSession, rows: DataFrame, path: str, not_null, schema: T.StructType, stored_form=None, dates=None) -> int:
    """Idempotent append; the row count comes from an observed metric of the
    write itself (no cache, no second pass). ``stored_form`` is applied to the rows that are left, after the exchange;
    ``dates``, all that the rows can have, spares reading the ids of others."""
    existing = _stored_or_none(spark, path, schema)
    if existing is not None and dates is not None:
        existing = existing.where(F.col("event_date").isin(dates))
    add = dealt_new_rows(rows, existing, not_null)
    add = add if stored_form is None else stored_form(add)
    obs = Observation("vigil_append")
    add = add.observe(obs, F.count(F.lit(1)).alias("rows"))
    with _WRITERS:  # queries of one driver that append to one folder would clear each other's uncommitted files
        add.write.mode("append").partitionBy("event_date").parquet(path)
    return _observed(obs)


def _observed(obs: Observation) -> int:
    """The observed row count; none when the adaptive plan found the batch empty and left the whole write out."""
    try:
        return int(obs.get.get("rows", 0))
    except Py4JJavaError:
        return 0


def append_events(spark: SparkSession, events: DataFrame, path: str, dates: list[_dt.date] | None = None) -> int:
    """Store EVENT rows into the events table (INSERT OR IGNORE by id). ``dates``: those of the events, if the caller knows them.

    Returns the number of rows written."""
    rows = events.select(*EVENT_COLUMNS, F.to_date("timestamp").alias("event_date"))
    return _append(spark, rows, path, EVENT_NOT_NULL, EVENT_TABLE, lambda new: to_stored_events(new, date=F.col("event_date")), dates)


def append_alerts(spark: SparkSession, alerts: DataFrame, path: str) -> int:
    """Store alerts (before de-duplication, as the reference does)."""
    return _append(spark, to_stored_alerts(alerts), path, ALERT_NOT_NULL, STORED_ALERT)


def read_events(spark: SparkSession, path: str, decode_text: bool = False) -> DataFrame:
    """Scan of the events table as EVENT rows; ``event_date`` (the
    partition column) is kept so time filters can prune partitions. ``decode_text``: see ``from_stored_events``."""
    stored = spark.read.schema(stored_schema(EVENT_TABLE)).parquet(path)
    return from_stored_events(stored, keep=("event_date",), decode_text=decode_text)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(stored_schema(STORED_ALERT)).parquet(path)


def table_dates(spark: SparkSession, path: str) -> list[_dt.date]:
    """The dates a table has partitions of, newest first (one name a day is listed, no file is opened)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    days = [n.partition("=")[2] for n in names if n.startswith("event_date=")]
    return sorted((_dt.date.fromisoformat(d) for d in days if d[:1].isdigit()), reverse=True)


def stored_schema(s: T.StructType) -> T.StructType:
    return T.StructType(list(s.fields) + [T.StructField("event_date", T.DateType())])


def event_struct(c=F.col) -> Column:
    """An event as its JSON object has it: ISO time, without the parsed fields."""
    return F.struct(c("id").alias("id"), iso_time(c("timestamp")).alias("timestamp"), c("source").alias("source"),
                    c("hostname").alias("hostname"), c("severity").alias("severity"), c("message").alias("message"),
                    c("raw").alias("raw"))


def event_text(c=F.col) -> Column:
    """JSON text of an event; ``c`` names its columns (``F.col``, or a getter of a nested event)."""
    parsed = parsed_json(c("parsed_fields"), c("ip_addresses"), c("geo"))
    return F.concat(F.regexp_replace(F.to_json(event_struct(c), {"ignoreNullFields": "false"}), r"\}$", ""),
                    F.lit(',"parsed_fields":'), parsed, F.lit("}"))


def event_json(events: DataFrame) -> DataFrame:
    """EVENT rows -> one JSON object each."""
    return events.select(event_text().alias("value"))


_EVENT_JSON = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "timestamp", "source", "hostname", "severity", "message", "raw", "parsed_fields")])
_ALERT_JSON = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "rule_id", "rule_name", "severity", "event", "timestamp", "description")])


def _object(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_o``, the JSON object of ``text``, and ``_m``, its parsed fields, each decoded once a row: read straight from
    ``from_json``, every field would be a decoding of its own."""
    df = generated(df.select("*", F.from_json(text, _EVENT_JSON).alias("_o")), "_o")
    fields = F.from_json(F.nullif(F.col("_o.parsed_fields"), F.lit("")), "map<string,string>")
    return generated(df.select("*", fields.alias("_m")), "_m")


def _event_columns(text: Column) -> list[Column]:
    """EVENT columns of the decoded object (``_object``), with the defaults: hostname 'unknown', severity parsed (unknown -> low),
    raw = message, no parsed fields -> empty map, no id -> a hash of the object's text."""
    from vigil.functions.text import parse_severity
    o = F.col("_o")
    return [
        F.coalesce(o["id"], F.sha2(text, 256)).alias("id"),
        F.to_timestamp(o["timestamp"]).alias("timestamp"),
        o["source"].alias("source"),
        F.coalesce(o["hostname"], F.lit("unknown")).alias("hostname"),
        parse_severity(F.coalesce(o["severity"], F.lit("low"))).alias("severity"),
        o["message"].alias("message"),
        F.coalesce(o["raw"], o["message"]).alias("raw"),
        *typed_columns(F.col("_m")),
    ]


def event_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON objects -> EVENT rows."""
    rows = generated(df.select(F.col(col).alias("_text")), "_text")
    return _object(rows, F.col("_text")).select(*_event_columns(F.col("_text")))


def alert_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON objects -> ALERT rows, the event nested; the defaults are those of events (severity unknown -> low, no
    id -> a hash of the object's text)."""
    from vigil.functions.text import parse_severity
    rows = generated(df.select(F.col(col).alias("_text")), "_text")
    rows = _object(generated(rows.select("_text", F.from_json("_text", _ALERT_JSON).alias("_a")), "_a"), F.col("_a.event"))
    event = F.struct(*_event_columns(F.col("_a.event")))
    return rows.select(
        F.coalesce(F.col("_a.id"), F.sha2(F.col("_text"), 256)).alias("id"), F.col("_a.rule_id").alias("rule_id"),
        F.col("_a.rule_name").alias("rule_name"),
        parse_severity(F.coalesce(F.col("_a.severity"), F.lit("low"))).alias("severity"),
        event["id"].alias("event_id"), event.alias("event"), F.to_timestamp(F.col("_a.timestamp")).alias("timestamp"),
        F.col("_a.description").alias("description"))
