"""Detection: EVENT rows x rules -> ALERT rows (batch, event time).

Plan shape (see ``explain``):

* plain rules: one projection evaluates every rule on every event and ``explode``s the hits. No shuffle,
  whatever the number of rules. Of a large rule set only the groups that hold a candidate (``prefilter``) are evaluated.
* threshold rules ("N matches per key within W"): only (rule, key, time, id) of the matching events is shuffled and
  counted. A rule's time line is cut in steps of at most W/64 (a minute at most) and blocks of BLOCK steps, and a count over
  [t - W, t] is a difference of two running counts: up to the match itself, and up to the window's start. Each is the
  place inside one step plus the matches of the steps before it in its block; a window that reaches into the block
  before adds what is left of that one, and only windows longer than a block (days) sum up block totals, which are
  few. So a task holds one step or one block of a key, however long the time line and however hot the key.
* the matching events are then joined with the ids that fire.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.partitioning import generated
from vigil.operators.prefilter import UNKNOWN, candidates, needs_of
from vigil.operators.rules import Compiler, Rule
from vigil.schema import EVENT_COLUMNS

ID_SEP = "\u0001"
GROUP = 32                # rules of one group; no candidates are looked for among fewer


@dataclass
class _Plan:
    plain: list          # (ordinal, predicate)
    by_window: dict      # window_us -> [(ordinal, ThresholdSpec)]
    helpers: dict
    candidates: Column | None = None   # ordinals of the plain rules that can hold, of large rule sets


def _plan(rules: list[Rule], group: int = GROUP) -> _Plan:
    comp = Compiler()
    plain, by_window = [], defaultdict(list)
    for i, r in enumerate(rules):
        if r.is_threshold:
            spec = comp.threshold(r)
            if spec is None:
                continue
            w = spec.window_us
            if w is None:  # no event is ever inside the window: count is 0
                if spec.need <= 0:
                    plain.append((i, spec.match))
                continue
            if spec.need <= 1:  # the current match alone reaches the threshold
                plain.append((i, spec.match))
                continue
            by_window[w].append((i, spec))
        else:
            plain.append((i, comp.plain_predicate(r)))
    found = None
    if len(plain) > group:
        needs = {o: needs_of(rules[o]) for o, _ in plain if not rules[o].is_threshold}
        fields = {name for n in needs.values() for name, _ in n.any_of or ()}
        found = candidates({o: needs.get(o, UNKNOWN) for o, _ in plain}, {name: comp._lower(name) for name in fields})
    return _Plan(plain, dict(by_window), comp.helpers, found)


def alert_id(rule_id: Column, rule_name: Column, event_id: Column) -> Column:
    return F.sha2(F.concat_ws(ID_SEP, rule_id, rule_name, event_id), 256)


def _rule_meta(rules: list[Rule], ordinal: Column) -> Column:
    meta = F.array(*[
        F.struct(F.lit(r.id).cast("string").alias("rule_id"), F.lit(str(r.title)).alias("rule_name"),
                 F.lit(r.severity).alias("severity"), F.lit(str(r.description)).alias("description"))
        for r in rules
    ])
    return F.element_at(meta, ordinal + 1)


STEPS = 64                        # steps of one window
LONGEST_STEP = 60_000_000         # microseconds
BLOCK = 4096                      # steps of one block
ENDLESS = 2**62                   # a window that reaches back to the first match


def _step(w):
    """Microseconds of a step for windows of ``w`` (a column)."""
    return F.least(F.greatest(F.ceil(w / STEPS), F.lit(1)), F.lit(LONGEST_STEP)).cast("long")


def _within_blocks(w, step):
    """Whether a window reaches back into the block before at most."""
    return w <= (BLOCK - 2) * step


def block_counts(marks: DataFrame, keys: list[str], long_windows: bool) -> DataFrame:
    """(keys, _cell, _before, _block_n) of every step that holds a mark: the matches before it in its block (for long windows, in
    all blocks) and those of its whole block. A task holds the steps of one block, or the totals of a key's blocks."""
    block = [*keys, "_block"]
    cells = marks.groupBy(*block, "_cell", "_local").agg(F.count_if("entry").alias("_n"))
    own = Window.partitionBy(*block)
    cells = cells.select(*block, "_cell", "_local", F.sum("_n").over(own).alias("_block_n"),
                         F.coalesce(F.sum("_n").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    if not long_windows:
        return cells.select(*keys, "_cell", "_before", "_block_n")
    totals = marks.where("not _local").groupBy(*block).agg(F.count_if("entry").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in block], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_blocks_n"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in block])
    return cells.join(totals, same, "left").select(*keys, "_cell", (F.col("_before") + F.coalesce("_blocks_n", F.lit(0))).alias("_before"), "_block_n")


def window_marks(df: DataFrame, keys: list[str], ts_us: str, row_id: str, w: Column) -> DataFrame:
    """Every match as an entry at its time and a probe at its window's start, with their steps and blocks."""
    rows = df.select(*keys, F.col(row_id).alias("_row"), F.col(ts_us).alias("_t"), w.alias("_w"), _step(w).alias("_step"))
    start = F.col("_t") - F.col("_w")
    both = F.explode(F.array(
        F.struct(F.lit(True).alias("entry"), F.col("_t").alias("at")), F.struct(F.lit(False).alias("entry"), start.alias("at"))))
    marks = rows.select(*keys, "_row", "_t", "_step", _within_blocks(F.col("_w"), F.col("_step")).alias("_local"), both.alias("_m")).select(
        *keys, "_row", "_t", "_step", "_local", "_m.entry", "_m.at", F.floor(F.col("_m.at") / F.col("_step")).cast("long").alias("_cell"))
    block = F.floor(F.col("_cell") / BLOCK).cast("long")
    entered = F.floor(F.floor(F.col("_t") / F.col("_step")) / BLOCK).cast("long")
    return marks.select(*keys, "_row", "_local", "entry", "at", "_cell", block.alias("_block"), (F.col("_local") & (block < entered)).alias("_earlier"))


def trailing_count(df: DataFrame, keys: list[str], ts_us: str, row_id: str, window: Column | int,
                   out: str = "match_count", longest: int = ENDLESS) -> DataFrame:
    """(keys, row_id, out): for every row, the rows of equal ``keys`` with time in [t - W, t] that come at or before it in
    (time, ``row_id``) order. ``row_id`` is unique within the keys; ``window`` is W in microseconds, one for a key, and
    ``longest`` an upper bound of all windows."""
    w = F.lit(window).cast("long") if isinstance(window, int) else window.cast("long")
    marks = window_marks(df, keys, ts_us, row_id, w)
    cell = [*keys, "_cell"]
    counts = block_counts(marks, keys, longest > (BLOCK - 2) * LONGEST_STEP)
    # an entry at the very time of a probe comes after it
    inside = Window.partitionBy(*cell).orderBy("at", F.col("entry"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in cell], "_before", "_block_n")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell])
    placed = marks.withColumn("_inside", F.count_if("entry").over(inside)).join(counts, same)
    running = F.col("_before") + F.col("_inside")
    share = F.when(F.col("entry"), running).otherwise(F.when(F.col("_earlier"), F.col("_block_n")).otherwise(0) - running)
    return placed.groupBy(*keys, F.col("_row").alias(row_id)).agg(F.sum(share).cast("long").alias(out))


def plain_hits(ev: DataFrame, plan: _Plan, group: int = GROUP) -> DataFrame:
    """Hits of the plain rules: one narrow pass."""
    def holding(rules: list) -> Column:
        return F.filter(F.array(*[F.when(p, F.lit(o)) for o, p in rules]), lambda x: x.isNotNull())

    columns = ev.columns
    if plan.candidates is None:
        hits = holding(plan.plain)
    else:
        ev = generated(ev.withColumn("_can", plan.candidates), "_can")
        groups = [plan.plain[i:i + group] for i in range(0, len(plan.plain), group)]
        none = F.array().cast("array<int>")
        hits = F.flatten(F.array(*[
            F.when(F.arrays_overlap("_can", F.array(*[F.lit(o) for o, _ in g])), holding(g)).otherwise(none) for g in groups]))
    return (ev.select(*columns, F.explode(hits).alias("rule_ord"))
            .withColumns({"group_key": F.lit(None).cast("string"), "match_count": F.lit(None).cast("long")}))


def _threshold_hits(ev: DataFrame, by_window: dict) -> DataFrame:
    """Hits of the threshold rules: narrow counts, then the events of the matches that fire."""
    specs = [(o, s, w) for w, own in by_window.items() for o, s in own]
    items = F.filter(F.array(*[
        F.when(s.match, F.struct(F.lit(o).alias("o"), s.key.cast("string").alias("k"), F.lit(w).cast("long").alias("w"), F.lit(s.need).alias("n")))
        for o, s, w in specs]), lambda x: x.isNotNull())
    found = ev.select("id", F.unix_micros("timestamp").alias("_ts"), F.explode(items).alias("_hit")).where("_ts is not null").select(
        "id", "_ts", F.col("_hit.o").alias("rule_ord"), F.col("_hit.k").alias("group_key"), F.col("_hit.w").alias("_w"), F.col("_hit.n").alias("_need"))
    counted = trailing_count(found, ["rule_ord", "group_key", "_need"], "_ts", "id", F.col("_w"), longest=max(by_window))
    fired = counted.where(F.col("match_count") >= F.col("_need")).select("id", "rule_ord", "group_key", "match_count")
    matching = ev.where(reduce(Column.__or__, [s.match for _, s, _ in specs]))  # only these rows are shuffled by id
    return matching.join(fired, "id").select(*ev.columns, "rule_ord", "group_key", "match_count")


def rule_hits(events: DataFrame, rules: list[Rule], group: int = GROUP) -> DataFrame:
    """Event rows that fire, one row per (event, rule): event columns plus
    ``rule_ord`` (index into ``rules``), ``group_key`` and ``match_count``
    (threshold rules only). Matches of equal time count in the order of their event ids."""
    plan = _plan(rules, group)
    ev = events.select("*", *[c.alias(k) for k, c in plan.helpers.items()])
    parts = ([plain_hits(ev, plan, group)] if plan.plain else []) + ([_threshold_hits(ev, plan.by_window)] if plan.by_window else [])
    if not parts:
        parts = [plain_hits(ev, _Plan([(0, F.lit(False))], {}, {}))]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.drop(*plan.helpers.keys())


def detect(events: DataFrame, rules: list[Rule], nested_event: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """EVENT rows -> ALERT rows: id, rule_id, rule_name, severity, event_id,
    event (nested), timestamp (= event time), description, rule_ord and any
    ``keep`` columns of the event rows."""
    hits = rule_hits(events, rules)
    meta = _rule_meta(rules, F.col("rule_ord")) if rules else F.lit(None)
    cols = [
        alert_id(meta["rule_id"], meta["rule_name"], F.col("id")).alias("id"),
        meta["rule_id"].alias("rule_id"),
        meta["rule_name"].alias("rule_name"),
        meta["severity"].alias("severity"),
        F.col("id").alias("event_id"),
    ]
    if nested_event:
        cols.append(F.struct(*[F.col(c) for c in EVENT_COLUMNS if c in events.columns]).alias("event"))
    cols += [F.col("timestamp"), meta["description"].alias("description"), F.col("rule_ord"),
             F.col("match_count"), *[F.col(k) for k in keep]]
    return hits.select(*cols)

