import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import UTC
from vigil.operators.dedup import dedup, dispatch_stats

T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def alerts(spark, items):
    """items: (key, seconds, seq) -> flat alert rows keyed by rule_id."""
    rows = [(f"a{i}", k, "src", "host", T0 + dt.timedelta(seconds=s), seq) for i, (k, s, seq) in enumerate(items)]
    return spark.createDataFrame(rows, "id string, rule_id string, source string, hostname string, "
                                       "timestamp timestamp, seq long")


def keys():
    return [F.col("rule_id"), F.col("source"), F.col("hostname")]


def kept(spark, items, window):
    d = dedup(alerts(spark, items).repartition(3), window, keys=keys(), order_cols=["seq"])
    return sorted(r["id"] for r in d.filter("dispatched").collect())


def brute(items, window):
    out, last = [], {}
    order = sorted(range(len(items)), key=lambda i: (items[i][1], items[i][2], f"a{i}"))
    for i in order:
        k, s, _ = items[i]
        if k not in last or s - last[k] > window:
            last[k] = s
            out.append(f"a{i}")
    return sorted(out)


def test_fixture_cases(spark):
    items = [("r", s, i) for i, s in enumerate([0, 30, 60, 60, 121])]
    assert kept(spark, items, 60) == ["a0", "a4"]
    assert kept(spark, [("r", 0, 0), ("r", 300, 1)], 300) == ["a0"]  # boundary is suppressed
    assert kept(spark, [("r", 0, 0), ("r", 301, 1)], 300) == ["a0", "a1"]


@pytest.mark.parametrize("window,seed", [(60, 7), (1, 8), (5000, 9)])
def test_random_against_brute_force(spark, window, seed):
    """Chains over many buckets, keys with pauses of several buckets, ties."""
    rnd = random.Random(seed)
    items = []
    for k in ["hot", "b", "c"]:
        t = 0
        for i in range(400 if k == "hot" else 60):
            t += rnd.choice([0, 1, 5, 20, 40, 70, 200, 700, 9000])
            items.append((k, t, rnd.randint(0, 10**6)))
    rnd.shuffle(items)
    assert kept(spark, items, window) == brute(items, window)


def test_window_zero_and_stats(spark):
    items = [("r", 0, 0), ("r", 0, 1), ("r", 10, 2)]
    assert kept(spark, items, 0) == ["a0", "a1", "a2"]
    d = dedup(alerts(spark, items), 60, keys=keys(), order_cols=["seq"])
    s = dispatch_stats(d, handlers=2).collect()[0]
    assert (s["total_dispatched"], s["total_suppressed"], s["active_handlers"]) == (1, 2, 2)


def test_struct_key_has_no_separator_collision(spark):
    rows = [("a1", "a:b", "c", "h", T0, 0), ("a2", "a", "b:c", "h", T0 + dt.timedelta(seconds=1), 1)]
    df = spark.createDataFrame(rows, "id string, rule_id string, source string, hostname string, "
                                     "timestamp timestamp, seq long")
    d = dedup(df, 300, keys=keys(), order_cols=["seq"])
    assert sorted(r["id"] for r in d.filter("dispatched").collect()) == ["a1", "a2"]


def test_hot_key_over_years_is_composed_from_small_functions(spark):
    """One key behind all alerts for three years: equal to the plain walk; what is handed up the tree is a few numbers a
    bucket, and the walk over a key sees one row for every 4096 windows."""
    from vigil.operators import dedup as D
    rnd = random.Random(3)
    t, items = 0, []
    for i in range(60_000):
        t += rnd.choice([0, 0, 1, 7, 40, 299, 300, 301, 900, 9000])
        items.append(("hot", t, rnd.randint(0, 9)))
    assert t > 2 * 365 * 86400
    rnd.shuffle(items)
    assert kept(spark, items, 300) == brute(items, 300)
    w = 300_000_000
    times = spark.createDataFrame([("hot", s * 1_000_000) for s in {x[1] for x in items}], "_key string, _t long")
    buckets = D._bucket_steps(times.withColumn("_bucket", F.floor(F.col("_t") / (D.SPAN * w)).cast("long")), w)
    rows = buckets.agg(F.max(F.size("_limits")).alias("steps"), F.count(F.lit(1)).alias("n")).head()
    assert rows["steps"] < 20 and rows["n"] > 3000
    groups = D._group_steps(buckets, w)
    assert groups.count() <= t / (300 * D.SPAN * D.FAN) + 2


def test_streamed_functions_do_not_depend_on_batches():
    """The function of a bucket is the same however its sorted times are cut into batches."""
    import numpy as np

    from vigil.operators.dedup import _Steps
    rnd = random.Random(4)
    for _ in range(200):
        w = rnd.choice([1, 5, 50])
        t = np.unique([rnd.randint(0, 64 * w) for _ in range(rnd.randint(1, 120))])
        n = min(len(t), int(np.searchsorted(t, w, side="right")) + 1)
        whole = _Steps(t[:n], t[:n]).through(t, w)
        cut = _Steps(t[:n], t[:n])
        at = 0
        while at < len(t):
            step = rnd.randint(1, 9)
            cut, at = cut.through(t[at:at + step], w), at + step
        for last in [-(1 << 62), *range(-2 * w, 1)]:
            now, out = last, last
            for x in t.tolist():
                if x > now + w:
                    now = out = x
            assert whole.after(np.array([last]), w)[0] == out == cut.after(np.array([last]), w)[0]
