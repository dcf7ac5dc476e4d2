"""Windowed first-wins alert de-duplication (exact), plus its statistics.

Semantics: per key (rule id, event source, event host), walk alerts in
(time, order) order; an alert is dispatched when no dispatched alert of the
key lies within ``W`` before it (``t - last <= W`` suppresses). Suppressed
alerts do not move ``last``. The result is greedy and order dependent, so
neither ``lag`` nor ``dropDuplicates`` gives it.

One algorithm at all sizes, on a narrow projection, with no driver loop:

1. Alerts of a key at one time collapse to the first in order (combined before the exchange): the others are suppressed.
2. A key's time line is cut in buckets of SPAN windows. What a bucket does depends only on the last dispatch before it,
   and never gets earlier when that one gets later: a monotone step function from the last dispatch before the bucket to the
   last one in it. It is built while the times stream by, from the chains that start in the bucket's first window;
   chains that have met are one step, so a few numbers are left.
3. Functions of FAN buckets are composed to that of their group, those of a key's groups are walked in order, and the last
   dispatch before a group is carried down through its buckets: a tree whose tasks hold a FAN-th of a level.
4. Each bucket's times are walked from the last dispatch before it, carrying one number.

No task holds the alerts of a key, of a bucket or of one time: they stream by, spread over the key's buckets. The flags go back to
the alerts by row id; ``dispatched`` joins only the dispatched ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_WINDOW_S = 300
SPAN = 64              # windows of a bucket
FAN = 64               # buckets of a group
ROWS = 256             # rows of an Arrow batch of functions
NEVER = -(1 << 62)     # before the first dispatch
STEPS = "_limits array<long>, _exits array<long>"


def _key_col(cols: list[Column]) -> Column:
    # JSON text of a struct: unambiguous (a ':' inside a name cannot collide).
    return F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)]))


def default_keys() -> list[Column]:
    return [F.col("rule_id"), F.col("event.source"), F.col("event.hostname")]


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(group, whether it starts here, its rows) for every stretch of equal ``by`` in sorted batches; a group may span batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in by:
            v = b.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change).tolist()
        for a, z in zip(starts, [*starts[1:], b.num_rows]):
            group = tuple(b.column(c)[a].as_py() for c in by)
            yield group, group != held, b.slice(a, z - a)
            held = group


class _Steps:
    """A monotone step function: a last dispatch before maps to the exit of the first step whose limit lies beyond it
    by more than the window, or to itself behind all steps."""

    def __init__(self, limits: np.ndarray, exits: np.ndarray):
        self.limits, self.exits = limits, exits

    def after(self, last: np.ndarray, w: int) -> np.ndarray:
        at = np.searchsorted(self.limits, last + w, side="right")
        return np.where(at < len(self.exits), self.exits[np.minimum(at, len(self.exits) - 1)], last)

    def merged(self) -> _Steps:
        """Steps with equal exits are one."""
        keep = np.append(self.exits[1:] != self.exits[:-1], True)
        return _Steps(self.limits[keep], self.exits[keep])

    def through(self, times: np.ndarray, w: int) -> _Steps:
        """Every exit carried on through later times."""
        exits = self.exits
        while True:
            at = np.searchsorted(times, exits + w, side="right")
            on = at < len(times)
            if not on.any():
                return _Steps(self.limits, exits).merged()
            exits = np.where(on, times[np.minimum(at, len(times) - 1)], exits)


def _numbers(c: pa.Array, i: int) -> np.ndarray:
    return c[i].values.to_numpy(zero_copy_only=False)


def _emit(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"_key": pa.string(), "_limits": pa.list_(pa.int64()), "_exits": pa.list_(pa.int64()), "_parts": _PARTS}
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for c, n in zip(cols, names)], names=names)


def _bucket_steps(times: DataFrame, w: int) -> DataFrame:
    """(_key, _bucket, _limits, _exits): the step function of every bucket."""
    names = ["_key", "_bucket", "_limits", "_exits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, steps, open_, done = None, None, True, []
        for g, new, rows in _groups(batches, ["_key", "_bucket"]):
            if new:
                if steps is not None:
                    done.append((*group, steps.limits.tolist(), steps.exits.tolist()))
                    if len(done) >= ROWS:
                        yield _emit(done, names)
                        done = []
                group, open_, steps = g, True, _Steps(np.empty(0, np.int64), np.empty(0, np.int64))
            t = rows.column("_t").to_numpy()
            if open_:  # the bucket's first window and the next time are where it can be entered
                n = int(np.searchsorted(t, g[1] * SPAN * w + w, side="right"))
                open_, n = n == len(t), min(n + 1, len(t))
                steps = _Steps(np.concatenate([steps.limits, t[:n]]), np.concatenate([steps.exits, t[:n]]))
            steps = steps.through(t, w)
        if steps is not None:
            yield _emit([*done, (*group, steps.limits.tolist(), steps.exits.tolist())], names)

    dealt = times.repartition("_key", "_bucket").sortWithinPartitions("_key", "_bucket", "_t").select("_key", "_bucket", "_t")
    return dealt.mapInArrow(run, f"_key string, _bucket long, {STEPS}").withColumn("_group", F.floor(F.col("_bucket") / FAN).cast("long"))


PARTS = "_parts array<struct<bucket:bigint,limits:array<bigint>,exits:array<bigint>>>"
_PARTS = pa.list_(pa.struct([("bucket", pa.int64()), ("limits", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))]))


def _group_steps(buckets: DataFrame, w: int) -> DataFrame:
    """(_key, _group, _limits, _exits, _parts): the functions of a group's buckets one after the other, and they themselves."""
    names = ["_key", "_group", "_limits", "_exits", "_parts"]

    def row(group: tuple, parts: list) -> pa.RecordBatch:
        steps = parts[0][1]
        for _, own in parts[1:]:
            steps = _Steps(steps.limits, own.after(steps.exits, w)).merged()
        each = [{"bucket": b, "limits": own.limits.tolist(), "exits": own.exits.tolist()} for b, own in parts]
        return _emit([(*group, steps.limits.tolist(), steps.exits.tolist(), each)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for g, new, rows in _groups(batches, ["_key", "_group"]):
            if new and parts:
                yield row(group, parts)
                parts = []
            group = g
            for i in range(rows.num_rows):  # at most FAN functions of a few numbers
                parts.append((rows.column("_bucket")[i].as_py(), _Steps(_numbers(rows.column("_limits"), i), _numbers(rows.column("_exits"), i))))
        if parts:
            yield row(group, parts)

    dealt = buckets.repartition("_key", "_group").sortWithinPartitions("_key", "_group", "_bucket")
    return dealt.select("_key", "_group", "_bucket", "_limits", "_exits").mapInArrow(run, f"_key string, _group long, {STEPS}, {PARTS}")


def _before_groups(groups: DataFrame, w: int) -> DataFrame:
    """(_key, _group, _last, _parts): the last dispatch before every group of a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([NEVER])
        for _, new, part in _groups(batches, ["_key"]):
            if new:
                last = np.array([NEVER])
            out = []
            for i in range(part.num_rows):
                out.append(int(last[0]))
                last = _Steps(_numbers(part.column("_limits"), i), _numbers(part.column("_exits"), i)).after(last, w)
            yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_group"), pa.array(out, pa.int64()), part.column("_parts")],
                                             names=["_key", "_group", "_last", "_parts"])

    dealt = groups.repartition("_key").sortWithinPartitions("_key", "_group")
    return dealt.mapInArrow(run, f"_key string, _group long, _last long, {PARTS}")


def _before_buckets(groups: DataFrame, w: int) -> DataFrame:
    """(_key, _bucket, _last): the last dispatch before every bucket, carried down from its group's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, last, parts in zip(b.column("_key").to_pylist(), b.column("_last").to_pylist(), b.column("_parts").to_pylist()):
                now = np.array([last])
                for p in parts:
                    out.append((key, p["bucket"], int(now[0])))
                    now = _Steps(np.array(p["limits"], np.int64), np.array(p["exits"], np.int64)).after(now, w)
            yield _emit(out, ["_key", "_bucket", "_last"])

    return groups.repartition("_key", "_group").mapInArrow(run, "_key string, _bucket long, _last long")


def _walk(rows: DataFrame, w: int) -> DataFrame:
    """Row ids of the dispatched alerts, from the last dispatch before each bucket on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = NEVER
        for _, new, part in _groups(batches, ["_key", "_bucket"]):
            if new:
                last = part.column("_last")[0].as_py()
            t, out = part.column("_t").to_numpy(), []
            i = int(np.searchsorted(t, last + w, side="right"))
            while i < len(t):
                out.append(i)
                last = int(t[i])
                i = int(np.searchsorted(t, last + w, side="right"))
            yield pa.RecordBatch.from_arrays([part.column("_rid").take(pa.array(out, pa.int64()))], names=["_rid"])

    dealt = rows.repartition("_key", "_bucket").sortWithinPartitions("_key", "_bucket", "_t").select("_key", "_bucket", "_t", "_last", "_rid")
    return dealt.mapInArrow(run, "_rid string")


def dispatched_ids(alerts: DataFrame, window_s: float = DEFAULT_WINDOW_S, keys: list[Column] | None = None,
                   order_cols: list[str] | None = None, row_id: str = "id") -> DataFrame:
    """(_rid) of the dispatched alerts. ``row_id`` must be unique; alerts without a time are never dispatched."""
    w = int(round(window_s * 1_000_000))
    order = list(order_cols or [])
    narrow = alerts.select(F.col(row_id).cast("string").alias("_rid"), _key_col(keys or default_keys()).alias("_key"),
                           F.unix_micros(F.col("timestamp")).alias("_t"), *order).where("_t is not null")
    first = F.min(F.struct(*order, "_rid"))["_rid"].alias("_rid")
    times = narrow.groupBy("_key", F.floor(F.col("_t") / F.lit(SPAN * w)).cast("long").alias("_bucket"), "_t").agg(first)
    groups = _before_groups(_group_steps(_bucket_steps(times, w), w), w)
    return _walk(times.join(_before_buckets(groups, w), ["_key", "_bucket"]), w)


def dedup(alerts: DataFrame, window_s: float = DEFAULT_WINDOW_S, keys: list[Column] | None = None,
          order_cols: list[str] | None = None, row_id: str = "id") -> DataFrame:
    """Alerts with a boolean ``dispatched`` column (False = suppressed); a window of 0 turns de-duplication off."""
    if window_s <= 0:
        return alerts.withColumn("dispatched", F.lit(True))
    flags = dispatched_ids(alerts, window_s, keys, order_cols, row_id).withColumn("_yes", F.lit(True))
    out = alerts.join(flags, F.col(row_id).cast("string") == flags["_rid"], "left")
    return out.withColumn("dispatched", F.coalesce("_yes", F.lit(False))).drop("_rid", "_yes")


def dispatched(alerts: DataFrame, window_s: float = DEFAULT_WINDOW_S, keys: list[Column] | None = None,
               order_cols: list[str] | None = None, row_id: str = "id") -> DataFrame:
    """Only the alerts that go out: a join with their ids."""
    if window_s <= 0:
        return alerts
    ids = dispatched_ids(alerts, window_s, keys, order_cols, row_id)
    return alerts.join(ids, F.col(row_id).cast("string") == ids["_rid"], "left_semi")


def dispatch_stats(flagged: DataFrame, handlers: int = 0) -> DataFrame:
    """One row: total_dispatched, total_suppressed, active_handlers."""
    return flagged.agg(
        F.count_if(F.col("dispatched")).alias("total_dispatched"),
        F.count_if(~F.col("dispatched")).alias("total_suppressed"),
    ).withColumn("active_handlers", F.lit(handlers))
