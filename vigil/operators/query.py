"""Listings and summary statistics over stored events / alerts.

Filters are plain column predicates, so Parquet pushdown and ``event_date``
partition pruning apply; newest-first pages plan as a top-k
(``TakeOrderedAndProject``), never a full sort to the driver. Deep pages go by
a cursor (``page_after``), which reads the days of the page alone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 1000


def _ts_lit(value) -> F.Column:
    if isinstance(value, _dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=_dt.timezone.utc)
        return F.timestamp_micros(F.lit(int(value.timestamp() * 1_000_000)))
    return F.to_timestamp(F.lit(str(value)))


def _filters(df: DataFrame, equal: dict, start=None, end=None) -> DataFrame:
    for col, value in equal.items():
        if value:  # empty or None = no filter, as the reference
            df = df.filter(F.col(col) == F.lit(value))
    if start:
        df = df.filter(F.col("timestamp") >= _ts_lit(start))
        if "event_date" in df.columns:
            df = df.filter(F.col("event_date") >= F.to_date(_ts_lit(start)))
    if end:
        df = df.filter(F.col("timestamp") <= _ts_lit(end))
        if "event_date" in df.columns:
            df = df.filter(F.col("event_date") <= F.to_date(_ts_lit(end)))
    return df


def newest_first(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, id as tie-break, then one page."""
    ordered = df.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def query_events(events: DataFrame, severity=None, source=None, hostname=None, start_time=None,
                 end_time=None, limit: int = 100, offset: int = 0) -> DataFrame:
    f = _filters(events, {"severity": severity, "source": source, "hostname": hostname}, start_time, end_time)
    return newest_first(f, limit, offset)


def query_alerts(alerts: DataFrame, severity=None, rule_id=None, start_time=None, end_time=None,
                 limit: int = 100, offset: int = 0) -> DataFrame:
    f = _filters(alerts, {"severity": severity, "rule_id": rule_id}, start_time, end_time)
    return newest_first(f, limit, offset)


def page_cursor(page: DataFrame) -> tuple[int, str] | None:
    """Where a page ends: (time in microseconds, id) of its last row; None for an empty page."""
    last = page.agg(F.min(F.struct(F.unix_micros("timestamp").alias("at"), "id")).alias("last")).select("last.at", "last.id").head()
    return None if last["at"] is None else (last["at"], last["id"])


def page_after(table: DataFrame, dates: list[_dt.date], cursor: tuple[int, str] | None = None, limit: int = 100,
               equal: dict | None = None, start_time=None, end_time=None) -> DataFrame:
    """The page that follows ``cursor`` (None: the first one), newest first; ``dates`` are the table's dates, newest first.

    Same rows as a page by offset, but its cost does not grow with how deep the page lies: days are asked from the
    cursor's on, newest first, in runs of 1, 2, 4, ... days, until they hold enough rows, and the page is the top of those
    days alone. A day without partition costs nothing."""
    check_page(limit, 0)
    rows = _filters(table, equal or {}, start_time, end_time)
    if cursor is not None:
        at, row_id = F.timestamp_micros(F.lit(cursor[0])), F.lit(cursor[1])
        rows = rows.where((F.col("timestamp") < at) | (F.col("timestamp") == at) & (F.col("id") < row_id)).where(F.col("timestamp") <= at)
        newest = (_dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=cursor[0])).date()
        dates = [d for d in dates if d <= newest]
    found, done, run = 0, 0, 1
    while done < len(dates) and found < limit:
        days = dates[done:done + run]
        within = rows.where(F.col("event_date").between(F.lit(days[-1]), F.lit(days[0])))
        found += within.select("id").limit(limit - found).count()
        done, run = done + len(days), 2 * run
    span = rows.where(F.col("event_date").between(F.lit(dates[done - 1]), F.lit(dates[0]))) if done else rows.where(F.lit(False))
    return newest_first(span, limit)


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be within 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def page_envelope(rows: DataFrame, limit: int, offset: int, name: str = "events") -> DataFrame:
    """One row: count (of this page), limit, offset and the page's rows.

    The page has at most ``limit`` (<= 1000) rows, so collecting it into one
    row is bounded."""
    check_page(limit, offset)
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.collect_list(F.struct(*rows.columns)).alias(name),
    ).select("count", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), name)


def totals(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: total_events, total_alerts (one pass over a union of markers)."""
    marks = (events.select(F.lit(1).alias("_e"), F.lit(0).alias("_a"))
             .unionByName(alerts.select(F.lit(0).alias("_e"), F.lit(1).alias("_a"))))
    return marks.agg(F.sum("_e").cast("long").alias("total_events"), F.sum("_a").cast("long").alias("total_alerts"))


def by_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def top_rules(alerts: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent rule names (name breaks ties)."""
    return (alerts.groupBy("rule_name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("rule_name")).limit(n))


def events_per_hour(events: DataFrame, now, hours: int = 24, whole_boundary_day: bool = False) -> DataFrame:
    """Events per hour label ``yyyy-MM-dd HH:00`` since ``now - hours``.

    ``whole_boundary_day`` reproduces the reference's text comparison, which
    keeps every event of the boundary day."""
    since = _ts_lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    cond = (F.col("timestamp") >= F.to_timestamp(F.to_date(since))) if whole_boundary_day \
        else (F.col("timestamp") >= since)
    return (events.filter(cond)
            .groupBy(F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd HH:00").alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("hour"))


def _hour_key(events: DataFrame, now, hours: int = 24, whole_boundary_day: bool = False):
    since = _ts_lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    cond = (F.col("timestamp") >= F.to_timestamp(F.to_date(since))) if whole_boundary_day \
        else (F.col("timestamp") >= since)
    return F.when(cond, F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd HH:00"))


def _event_metrics(events: DataFrame, now, whole_boundary_day: bool) -> DataFrame:
    """total / by severity / per hour from ONE aggregation pass (grouping sets)."""
    e = events.select("severity", _hour_key(events, now, whole_boundary_day=whole_boundary_day).alias("hour"))
    g = e.groupingSets([[], ["severity"], ["hour"]], "severity", "hour").agg(
        F.count(F.lit(1)).alias("value"), F.grouping_id().alias("gid"))
    # grouping_id bits: severity = 2, hour = 1 (1 = not grouped by it)
    return g.select(
        F.when(F.col("gid") == 3, "total_events").when(F.col("gid") == 1, "events_by_severity")
        .otherwise("events_per_hour").alias("metric"),
        F.when(F.col("gid") == 1, F.col("severity")).when(F.col("gid") == 2, F.col("hour")).alias("key"),
        "value",
    ).filter(~((F.col("metric") == "events_per_hour") & F.col("key").isNull()))


def _alert_metrics(alerts: DataFrame, top: int) -> DataFrame:
    """total / by severity / top rules from ONE aggregation pass; the top-k
    is a window over the aggregated rows (a few per rule), not a second
    branch over the alerts."""
    g = alerts.groupingSets([[], ["severity"], ["rule_name"]], "severity", "rule_name").agg(
        F.count(F.lit(1)).alias("value"), F.grouping_id().alias("gid"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.col("value").desc(), F.col("rule_name")))
    g = g.withColumn("_rank", rank).filter((F.col("gid") != 2) | (F.col("_rank") <= top))
    return g.select(
        F.when(F.col("gid") == 3, "total_alerts").when(F.col("gid") == 1, "alerts_by_severity")
        .otherwise("top_rules").alias("metric"),
        F.when(F.col("gid") == 1, F.col("severity")).when(F.col("gid") == 2, F.col("rule_name")).alias("key"),
        "value")


def stats_bundle(events: DataFrame, alerts: DataFrame, now, whole_boundary_day: bool = False) -> DataFrame:
    """All statistics in long form (metric, key, value): one aggregation pass
    over events and one over alerts."""
    return _event_metrics(events, now, whole_boundary_day).unionByName(_alert_metrics(alerts, 10))


def status_summary(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Totals, events by severity, the five most frequent rules (long form)."""
    ev = events.groupingSets([[], ["severity"]], "severity").agg(
        F.count(F.lit(1)).alias("value"), F.grouping_id().alias("gid"))
    ev = ev.select(F.when(F.col("gid") == 1, "total_events").otherwise("events_by_severity").alias("metric"),
                   F.when(F.col("gid") == 0, F.col("severity")).alias("key"), "value")
    al = _alert_metrics(alerts, 5).filter(F.col("metric") != "alerts_by_severity")
    return ev.unionByName(al)


def alerts_with_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Stored alerts joined to their stored events (left join on the id).

    When both tables carry ``event_date`` the join also matches on it, so
    only the event partitions of the alerts' dates are read."""
    ev = events.select(*[events[c].alias("ev_" + c) for c in events.columns])
    cond = [F.col("event_id") == F.col("ev_id")]
    if "event_date" in alerts.columns and "event_date" in events.columns:
        cond.append(F.col("event_date") == F.col("ev_event_date"))
    return alerts.join(ev, cond, "left")
