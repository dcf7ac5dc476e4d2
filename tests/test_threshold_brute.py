"""The bucketed trailing count equals a brute-force count (ties, W = 0,
windows longer than the data, a hot key)."""
import random

import pytest

from vigil.operators.detect import trailing_count


def brute(rows, w):
    out = {}
    for rid, k, t, tie in rows:
        out[rid] = sum(1 for (_, k2, t2, tie2) in rows
                       if k2 == k and t - w <= t2 <= t and (t2 < t or tie2 <= tie))
    return out


@pytest.mark.parametrize("w", [0, 1, 7, 60, 10**9, 2**62])
def test_trailing_count_matches_brute_force(spark, w):
    rnd = random.Random(w)
    rows = []
    for i in range(600):
        k = "hot" if i % 3 else rnd.choice(["a", "b", "c", None])
        t = rnd.randint(0, 400)
        rows.append((f"r{i}", k, t, i))
    df = spark.createDataFrame(rows, "rid string, k string, t long, tie long")
    got = {f"r{r['tie']}": r["match_count"] for r in trailing_count(df, ["k"], "t", "tie", w).collect()}
    assert got == brute(rows, w)


def test_day_window_on_one_key_spreads_over_steps(spark):
    """No task holds the key's day: the largest (key, step) group is a small share of the matches."""
    from pyspark.sql import functions as F

    from vigil.operators.detect import STEPS
    day = 86_400_000_000
    df = spark.range(5000).select(F.lit("__unknown__").alias("k"), (F.col("id") * 30_000_000).alias("t"), "id")
    got = trailing_count(df, ["k"], "t", "id", day)
    assert got.where(F.col("match_count") != F.least(F.col("id") + 1, F.lit(day // 30_000_000 + 1))).count() == 0
    assert df.groupBy(F.floor(F.col("t") / (day / STEPS))).count().agg(F.max("count")).head()[0] < 5000 / 50


def test_one_key_over_years_stays_within_blocks(spark):
    """All matches on one key, windows of a minute, three years of clock: no task holds more than a block of steps, none scans
    the key's whole line, and the counts stay exact."""
    from pyspark.sql import functions as F

    from vigil.operators.detect import BLOCK, block_counts, window_marks
    minute, n = 60_000_000, 40_000
    t = F.floor(F.col("id") / 4) * 9_460_800_000 + (F.col("id") % 4) * 21_000_000  # groups of four, 21 s apart
    df = spark.range(n).select(F.lit("__unknown__").alias("k"), t.alias("t"), "id")
    got = trailing_count(df, ["k"], "t", "id", minute, longest=minute)
    assert got.where(F.col("match_count") != F.least(F.col("id") % 4 + 1, F.lit(3))).count() == 0
    marks = window_marks(df, ["k"], "t", "id", F.lit(minute))
    assert marks.groupBy("_block").count().agg(F.max("count")).head()[0] <= 2 * 8 and marks.select("_block").distinct().count() > n / 5
    dense = window_marks(spark.range(30_000).select(F.lit("k").alias("k"), (F.col("id") * 400_000).alias("t"), "id"), ["k"], "t", "id", F.lit(minute))
    assert dense.groupBy("_block").agg(F.count_distinct("_cell").alias("n")).agg(F.max("n")).head()[0] <= BLOCK
    plan = block_counts(marks, ["k"], False)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert scans and all("_block" in line for line in scans)  # every running sum stops at a block


@pytest.mark.parametrize("w", [3600 * 24 * 2, 3600 * 24 * 30])
def test_windows_around_the_length_of_a_block(spark, w):
    rnd = random.Random(w)
    us = 1_000_000
    rows = [(f"r{i}", rnd.choice("ab"), rnd.randint(0, 100 * 24 * 3600) * us, i) for i in range(500)]
    df = spark.createDataFrame(rows, "rid string, k string, t long, tie long")
    got = {f"r{r['tie']}": r["match_count"] for r in trailing_count(df, ["k"], "t", "tie", w * us).collect()}
    assert got == brute(rows, w * us)
