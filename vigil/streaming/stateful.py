"""Stateful stream operators: threshold counting (F4) and alert dedup (G2).

All are ``transformWithStateInPandas`` processors in event-time mode, kept in the RocksDB state store and checkpointed
with the query, and cleaned up by event-time timers. State reaches back to ``watermark - W``, so rows that come out of
order but inside the watermark are counted and compared like the others.

Threshold counting has two stages. ``TimeCounts`` sees only times: per (rule, group key) it keeps how many matches fell
on each time, in panes of a window's length of which a micro-batch reads and writes those it touches, and tells every time
whose count may reach the threshold how many matches its window holds before it. ``WaitingMatches`` is keyed by a hash of
key and time, so the rows of a hot key spread over its times and those of many keys share a group; it holds the matches with
their payload until they fire or the watermark passes them. Calls to the state are what a group costs, so both stages keep
whole panes of time as one value and choose their width by the rows (a backlog of months has few panes).

A key's rows are ordered by (time, tie), so the threshold alerts are the batch's whatever the order of arrival. What
was sent stays sent: ``match_count`` is that of the moment, and a dispatch is not
taken back when an earlier alert comes later.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                      StatefulProcessorHandle, TimerValues)

from vigil.operators.dedup import default_keys
from vigil.session import ensure_state_store


def _frame(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    # One key's rows of one micro-batch (bounded by the trigger size).
    parts = [p for p in rows if len(p)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def _reset_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(at_ms)


def _watermark_us(timer_values: TimerValues) -> int:
    """The watermark, or a time before all events while there is none."""
    ms = timer_values.getCurrentWatermarkInMs()
    return ms * 1000 if ms > 0 else -(1 << 62)


LEAST_PANE = 1_000_000       # microseconds
LONGEST_PANE = 16 * 86_400_000_000
PANE_ROWS = 4096             # what a pane of a backlog is to hold
BUCKETS = 512                # groups of the second stage for each rule


def _pane_width(times: np.ndarray, least: int) -> int:
    """Width of a key's panes, fixed by its first micro-batch: the least one, doubled while a pane of this batch holds few rows, so
    that the calls to the state grow with the rows and not with the time that a backlog spans."""
    width, span = least, int(times.max()) - int(times.min())
    while width < LONGEST_PANE and 2 * width * len(times) <= PANE_ROWS * span:
        width *= 2
    return width


class TimeCounts(StatefulProcessor):
    """Per (rule, group key): the number of matches at every time that a row inside the watermark can still meet.

    Input columns: ``ev_us`` (µs), ``th_need``, ``th_window``. Emits (time, ``before``) for times that a row of the
    micro-batch entered or whose window it changed, if the threshold may be reached there: the matches in [t - W, t)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "times binary, counts binary")
        self.width = handle.getValueState("width", "us long")

    def _pane(self, pane: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.panes.containsKey((pane,)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        times, counts = self.panes.getValue((pane,))
        return np.frombuffer(bytes(times), np.int64), np.frombuffer(bytes(counts), np.int64)

    def handleInputRows(self, key, rows, timerValues: TimerValues):
        new, n, w, need = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        for part in rows:  # what is held is one number a distinct time
            if len(part):
                w, need = int(part["th_window"].iloc[0]), int(part["th_need"].iloc[0])
                new, n = _summed(np.concatenate([new, part["ev_us"].to_numpy(np.int64)]), np.concatenate([n, np.ones(len(part), np.int64)]))
        if not len(new):
            return
        if not self.width.exists():
            self.width.update((_pane_width(new, max(w, LEAST_PANE)),))
        pane = self.width.get()[0]
        touched = np.unique(new // pane).tolist()
        old = {p: self._pane(p) for p in sorted({q for p in touched for q in (p - 1, p, p + 1)})}
        for p in touched:
            own = new // pane == p
            if not len(old[p][0]):
                self.handle.registerTimer(min(((p + 2) * pane) // 1000 + 1, 1 << 53))
            old[p] = _summed(np.concatenate([old[p][0], new[own]]), np.concatenate([old[p][1], n[own]]))
            met = old[p][0] >= _watermark_us(timerValues) - w  # by rows that the watermark still lets in
            self.panes.updateValue((p,), (old[p][0][met].tobytes(), old[p][1][met].tobytes()))
        times = np.concatenate([t for t, _ in old.values()])
        count = np.concatenate([c for _, c in old.values()])
        running = np.concatenate([[0], np.cumsum(count)])
        before = running[:-1] - running[np.searchsorted(times, times - w, side="left")]
        changed = np.searchsorted(new, times, side="right") - 1
        told = (changed >= 0) & (new[np.maximum(changed, 0)] >= times - w) & (before + count >= need)
        told &= (times >= _watermark_us(timerValues)) | np.isin(times, new)
        if told.any():
            yield pd.DataFrame({"rule_ord": key[0], "group_key": key[1], "timestamp": pd.to_datetime(times[told], unit="us", utc=True), "ev_us": times[told], "before": before[told], "th_need": need})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        pane = self.width.get()[0]
        p = ((expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 + 999) // pane - 2
        if self.panes.containsKey((p,)):
            self.panes.removeKey((p,))
        return iter([])

    def close(self) -> None:
        pass


def _summed(times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct times in order, and their summed counts."""
    t, at = np.unique(times, return_inverse=True)
    return t, np.bincount(at, weights=counts, minlength=len(t)).astype(np.int64)


class WaitingMatches(StatefulProcessor):
    """Matches by (group key, time), and how many the window of each holds before them.

    A group is a bucket of a rule's (group key, time) pairs, whose state is kept in panes of time. Input columns: ``group_key``
    and ``ev_us`` (taken from the group's key (rule, group key, time) where it names them), ``ev_tie`` and ``ev_row`` (payload)
    of a match, or ``before``; ``th_need``. Emits a match, with ``match_count``, once its count of matches in [t - W, t]
    (itself included) reaches ``th_need``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "held binary")
        self.width = handle.getValueState("width", "us long")

    def handleInputRows(self, key, rows, timerValues: TimerValues):
        new, need = [], 0
        for part in rows:
            if len(part):
                need = int(part["th_need"].iloc[0])
                names = part["group_key"] if "group_key" in part else [key[1]] * len(part)
                times = part["ev_us"] if "ev_us" in part else [int(key[2])] * len(part)
                before = part["before"].astype("float64").fillna(-1).astype("int64")
                new += zip(names, times, part["ev_tie"], part["ev_row"], before)
        if not new:
            return
        if not self.width.exists():
            self.width.update((_pane_width(np.array([r[1] for r in new], np.int64), LEAST_PANE),))
        width, mark = self.width.get()[0], _watermark_us(timerValues)
        panes: dict[int, list] = {}
        for r in new:
            panes.setdefault(int(r[1]) // width, []).append(r)
        out = []
        for p in sorted(panes):
            known = self.panes.containsKey((p,))
            held = pickle.loads(bytes(self.panes.getValue((p,))[0])) if known else {}  # (group key, time) -> [before, matches]
            changed = set()
            for name, t, tie, row, before in panes.pop(p):
                at = (name, int(t))
                entry = held.setdefault(at, [-1, []])
                if before >= 0:
                    entry[0] = max(entry[0], before)
                else:
                    entry[1].append((tie, row))
                changed.add(at)
            for at in changed:
                out += [(at[1], *fired) for fired in _fire(held[at], need)]
            held = {at: entry for at, entry in held.items() if at[1] // 1000 * 1000 + 1000 > mark}
            self.panes.updateValue((p,), (pickle.dumps(held, 5),))
            if not known:
                self.handle.registerTimer(min(((p + 1) * width) // 1000 + 1, 1 << 53))
        if out:
            out = pd.DataFrame(out, columns=["ev_us", "ev_tie", "ev_row", "match_count"])
            out.insert(0, "timestamp", pd.to_datetime(out["ev_us"], unit="us", utc=True))
            yield out

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        p = ((expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 + 999) // self.width.get()[0] - 1
        if self.panes.containsKey((p,)):
            self.panes.removeKey((p,))
        return iter([])

    def close(self) -> None:
        pass


def _fire(entry: list, need: int) -> list[tuple]:
    """(tie, payload, count) of the waiting matches of a time that reach ``need``; they stay in ``entry`` without payload."""
    before, matches = entry
    if before < 0:
        return []
    matches.sort(key=lambda m: m[0])
    fired = [(i, tie, row) for i, (tie, row) in enumerate(matches) if row is not None and before + i + 1 >= need]
    for i, tie, _ in fired:
        matches[i] = tie, None
    return [(tie, row, before + i + 1) for i, tie, row in fired]


class DedupProcessor(StatefulProcessor):
    """Per dedup key: times of the dispatches that an alert inside the watermark can still meet. Adds ``dispatched``."""

    def __init__(self, window_us: int) -> None:
        self.w = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getListState("sent", "t long")

    def handleInputRows(self, key, rows, timerValues: TimerValues):
        pdf = _frame(rows)
        if pdf.empty:
            return
        pdf = pdf.sort_values(["ev_us", "ev_tie"], kind="stable").reset_index(drop=True)
        sent = sorted(int(r[0]) for r in self.sent.get()) if self.sent.exists() else []
        t = pdf["ev_us"].to_numpy(dtype=np.int64)
        flags = np.zeros(len(t), dtype=bool)
        i = 0
        while i < len(t):  # one step a dispatch
            now = int(t[i])
            at = bisect_right(sent, now)
            last = sent[at - 1] if at else None
            if last is None or now - last > self.w:
                flags[i] = True
                insort(sent, now)
                last = now
            i = int(np.searchsorted(t, last + self.w, side="right"))
        pdf["dispatched"] = flags
        mark = _watermark_us(timerValues)
        self.sent.put([(x,) for x in sent if x >= mark - self.w] or [(sent[-1],)])
        _reset_timer(self.handle, (sent[-1] + self.w) // 1000 + 1)
        yield pdf

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        self.sent.clear()
        return iter([])

    def close(self) -> None:
        pass


def _with_field(schema: T.StructType, name: str, dtype: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, dtype)])


def stream_threshold(hits: DataFrame, tie: str) -> DataFrame:
    """Rule-hit stream -> alert-worthy hits, with ``match_count``.

    ``hits`` needs a watermark on ``timestamp``."""
    ensure_state_store(hits.sparkSession)
    d = hits.withColumn("ev_us", F.unix_micros("timestamp")).withColumn("ev_tie", F.col(tie).cast("string"))
    payload = [f for f in hits.schema.fields if f.name not in ("timestamp", "th_need", "th_window")]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    keys = ["rule_ord", "group_key"]
    told = T.StructType([d.schema["timestamp"], d.schema["ev_us"], T.StructField("before", T.LongType()), T.StructField("th_need", T.LongType())])
    counts = (d.select(*keys, "timestamp", "ev_us", F.col("th_need").cast("long").alias("th_need"), "th_window").groupBy(*keys)
              .transformWithStateInPandas(TimeCounts(), _keyed(told, d, keys), "Append", "EventTime", eventTimeColumnName="timestamp"))
    matches = d.select(*keys, "timestamp", "ev_us", "ev_tie", F.to_json(F.struct(*[f.name for f in payload]), exact).alias("ev_row"),
                       F.lit(None).cast("long").alias("before"), F.col("th_need").cast("long").alias("th_need"))
    both = matches.unionByName(counts, allowMissingColumns=True).withColumn(
        "bucket", F.pmod(F.xxhash64("group_key", "ev_us"), F.lit(BUCKETS)))
    out = T.StructType([d.schema["timestamp"], d.schema["ev_us"], T.StructField("ev_tie", T.StringType()), T.StructField("ev_row", T.StringType()),
                        T.StructField("match_count", T.LongType())])
    fired = both.groupBy("rule_ord", "bucket").transformWithStateInPandas(WaitingMatches(), out, "Append", "EventTime", eventTimeColumnName="timestamp")
    row = F.from_json("ev_row", T.StructType([T.StructField(f.name, f.dataType) for f in payload]), exact)
    return fired.withColumn("__row", row).select("timestamp", "ev_us", "ev_tie", "match_count", "__row.*")


def _keyed(schema: T.StructType, d: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([d.schema[k] for k in keys] + schema.fields)


def stream_dedup(alerts: DataFrame, window_s: float = 300, tie: str = "id") -> DataFrame:
    """Alert stream -> same rows plus ``dispatched``; needs a watermark."""
    ensure_state_store(alerts.sparkSession)
    w = int(round(window_s * 1_000_000))
    keys = default_keys() if "event" in alerts.columns else [F.col("rule_id"), F.col("source"), F.col("hostname")]
    d = (alerts.withColumn("ev_us", F.unix_micros("timestamp")).withColumn("ev_tie", F.col(tie).cast("string"))
         .withColumn("dedup_key", F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys)]))))
    if w <= 0:
        return d.withColumn("dispatched", F.lit(True)).drop("ev_us", "ev_tie", "dedup_key")
    out = _with_field(d.schema, "dispatched", T.BooleanType())
    res = d.groupBy("dedup_key").transformWithStateInPandas(DedupProcessor(w), out, "Append", "EventTime",
                                                      eventTimeColumnName="timestamp")
    return res.drop("ev_us", "ev_tie", "dedup_key")


def observe_stats(flagged: DataFrame, name: str = "vigil_dispatch", handlers: int = 0) -> DataFrame:
    """The stream form of ``dispatch_stats``: every micro-batch reports total_dispatched, total_suppressed and
    active_handlers under ``name`` in the query's progress (``observedMetrics``), without a second pass."""
    return flagged.observe(
        name, F.count_if(F.col("dispatched")).alias("total_dispatched"),
        F.count_if(~F.col("dispatched")).alias("total_suppressed"), F.max(F.lit(handlers)).alias("active_handlers"))
