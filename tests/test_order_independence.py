"""Shuffling or repartitioning the input must not change any result."""
from pyspark.sql import functions as F

from vigil.operators.builtin import builtin_rules
from vigil.operators.dedup import dedup
from vigil.operators.detect import detect
from vigil.plans.logview import view_events

SF = "/root/testdata/sf0.001"


def result(ev):
    al = detect(ev, builtin_rules(), keep=("seq",))
    d = dedup(al, 300, order_cols=["seq"])
    return sorted((r["id"], r["dispatched"], r["match_count"]) for r in
                  d.select("id", "dispatched", "match_count").collect())


def test_input_order_does_not_matter(spark):
    ev = view_events(spark, SF)
    base = result(ev)
    assert base and any(not x[1] for x in base)
    assert result(ev.repartition(7)) == base
    assert result(ev.orderBy(F.rand(5)).repartition(3, "hostname")) == base
