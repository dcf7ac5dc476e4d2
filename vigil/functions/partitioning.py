"""Narrow barriers that keep expensive expressions from being evaluated twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_rows(df: DataFrame, cond) -> DataFrame:
    """``df.filter(cond)`` for a condition on a column computed just before
    (a regex match, a JSON parse).

    A plain ``filter`` is pushed below the projection by inlining the
    expression, so the expensive part runs twice per row (in the filter and
    again in the projection). An ``explode`` of a zero- or one-element array
    drops the rows instead: it reads the computed column, runs in generated
    code, and filters on its output cannot be pushed past it."""
    keep = F.explode(F.when(cond, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return df.select("*", keep.alias("_keep_row")).drop("_keep_row")


def generated(df: DataFrame, col: str, cond=None, out: str | None = None) -> DataFrame:
    """Turn ``col`` (computed by the projection below) into the output of a
    one-row ``explode``; rows where ``cond`` is false are dropped.

    Later filters on values read from ``out`` stay above the explode, so an
    expensive expression behind ``col`` (a regex) is never inlined into them
    and runs once per row."""
    t = df.schema[col].dataType
    arr = F.array(F.col(col))
    gen = arr if cond is None else F.when(cond, arr).otherwise(F.array().cast(T.ArrayType(t)))
    return df.select(*[c for c in df.columns if c != col], F.explode(gen).alias(out or col))


def spread_by_input(df: DataFrame, read: list[DataFrame], *keys: str, per_split: int = 8) -> DataFrame:
    """``df`` dealt by ``keys`` to some partitions for every input split of ``read``, so that what a task holds of an aggregation
    by ``keys`` stays the same however large the input. (Spark would fix the number, or merge partitions by their compressed bytes.)"""
    return df.repartition(max(per_split * sum(r.rdd.getNumPartitions() for r in read), 1), *keys)
