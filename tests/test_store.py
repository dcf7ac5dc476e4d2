import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import UTC, events_df
from vigil.operators import query as Q
from vigil.operators.builtin import builtin_rules
from vigil.operators.detect import detect
from vigil.operators.normalize import normalize
from vigil.operators.sinks import alert_json, console_records, fan_out, file_sink, outbox_sink
from vigil.operators.store import (append_alerts, append_events, event_from_json, event_json, read_alerts,
                                   read_events)

T0 = dt.datetime(2024, 1, 1, 12, 0, tzinfo=UTC)


def ten_events(spark, normalized=True):
    sev = ["low", "medium", "high"]
    rows = [{"message": f"Failed password for u{i} from 10.0.0.{i} port 22", "id": f"e{i}",
             "timestamp": T0 + dt.timedelta(minutes=i), "severity": sev[i % 3],
             "source": "auth" if i % 2 else "syslog", "hostname": f"h{i % 2}"} for i in range(10)]
    df = events_df(spark, rows)
    return normalize(df) if normalized else df


def test_store_roundtrip_and_idempotent(spark, tmp_dir):
    ev = ten_events(spark)
    assert append_events(spark, ev, f"{tmp_dir}/events") == 10
    assert append_events(spark, ev, f"{tmp_dir}/events") == 0  # same ids: nothing added
    back = read_events(spark, f"{tmp_dir}/events")
    assert back.count() == 10
    r = back.filter("id = 'e3'").collect()[0]
    assert r["parsed_fields"]["user"] == "u3" and r["ip_addresses"] == ["10.0.0.3"]
    assert r["geo"]["10.0.0.3"]["type"] == "internal"
    # NULL in a required column: skipped like INSERT OR IGNORE does
    bad = ev.limit(1).withColumn("id", F.lit("new")).withColumn("hostname", F.lit(None).cast("string"))
    assert append_events(spark, bad, f"{tmp_dir}/events") == 0


def test_listing_filters_paging(spark):
    ev = ten_events(spark, normalized=False)
    assert Q.query_events(ev, severity="high").count() == 3
    assert Q.query_events(ev, source="auth").count() == 5
    assert Q.query_events(ev, severity="", source=None).count() == 10
    p1 = [r["id"] for r in Q.query_events(ev, limit=3, offset=0).collect()]
    p2 = [r["id"] for r in Q.query_events(ev, limit=3, offset=3).collect()]
    assert p1 == ["e9", "e8", "e7"] and p2 == ["e6", "e5", "e4"]
    rng = Q.query_events(ev, start_time="2024-01-01 12:02:00", end_time="2024-01-01 12:04:00")
    assert sorted(r["id"] for r in rng.collect()) == ["e2", "e3", "e4"]  # both ends included
    env = Q.page_envelope(Q.query_events(ev, limit=4).select("id"), 4, 0).collect()[0]
    assert env["count"] == 4 and env["limit"] == 4 and len(env["events"]) == 4
    with pytest.raises(ValueError):
        Q.page_envelope(ev, 0, 0)
    with pytest.raises(ValueError):
        Q.page_envelope(ev, 10, -1)


def test_stats(spark, tmp_dir):
    ev = ten_events(spark)
    al = detect(ev, builtin_rules())
    t = Q.totals(ev, al).collect()[0]
    assert (t["total_events"], t["total_alerts"]) == (10, 10)
    assert {r["severity"]: r["count"] for r in Q.by_severity(ev).collect()} == {"high": 10}
    top = Q.top_rules(al).collect()
    assert [(r["rule_name"], r["count"]) for r in top] == [("Failed SSH Login", 10)]
    hours = Q.events_per_hour(ev, T0 + dt.timedelta(hours=24, minutes=5)).collect()
    assert [(r["hour"], r["count"]) for r in hours] == [("2024-01-01 12:00", 5)]
    whole = Q.events_per_hour(ev, T0 + dt.timedelta(hours=24, minutes=5), whole_boundary_day=True).collect()
    assert [(r["hour"], r["count"]) for r in whole] == [("2024-01-01 12:00", 10)]
    b = Q.stats_bundle(ev, al, T0).collect()
    assert {(r["metric"], r["key"]): r["value"] for r in b}[("total_alerts", None)] == 10
    append_alerts(spark, al, f"{tmp_dir}/alerts")
    append_events(spark, ev, f"{tmp_dir}/events")
    j = Q.alerts_with_events(read_alerts(spark, f"{tmp_dir}/alerts"),
                             read_events(spark, f"{tmp_dir}/events").withColumn("event_date", F.to_date("timestamp")))
    assert j.filter("ev_id is not null").count() == 10


def test_json_and_sinks(spark, tmp_dir):
    ev = ten_events(spark)
    back = event_from_json(event_json(ev)).orderBy("id").collect()
    assert back[0]["timestamp"].replace(tzinfo=UTC) == T0 and back[0]["parsed_fields"]["user"] == "u0"
    al = detect(ev, builtin_rules())
    rec = console_records(al).collect()[0]
    assert rec["severity"] == "HIGH" and " @ " in rec["source"] and rec["time"].endswith("+00:00")
    assert alert_json(al).count() == 10

    def broken(df, batch_id):
        raise RuntimeError("sink down")

    res = fan_out(al, 0, [broken, file_sink(f"{tmp_dir}/alerts_jsonl"), outbox_sink(f"{tmp_dir}/outbox", "http://x")])
    assert res == {"sinks": 3, "failed": 1}
    assert spark.read.text(f"{tmp_dir}/alerts_jsonl").count() == 10
    assert spark.read.parquet(f"{tmp_dir}/outbox").count() == 10


def test_detect_stored(spark, tmp_dir):
    from vigil.plans.batch import detect_stored
    ev = ten_events(spark)
    append_events(spark, ev, f"{tmp_dir}/events")
    res = detect_stored(spark, f"{tmp_dir}/events", f"{tmp_dir}/alerts", rules_dir=f"{tmp_dir}/missing")
    assert res == {"rules": 8, "events": 10, "alerts": 10}
    again = detect_stored(spark, f"{tmp_dir}/events", f"{tmp_dir}/alerts")
    assert again["alerts"] == 0  # same alert ids: nothing new stored
    capped = detect_stored(spark, f"{tmp_dir}/events", f"{tmp_dir}/alerts2", newest=4)
    assert capped == {"rules": 8, "events": 4, "alerts": 4}


def test_listing_on_stored_table_is_pushed_down(spark, tmp_dir):
    append_events(spark, ten_events(spark, normalized=False), f"{tmp_dir}/events")
    ev = read_events(spark, f"{tmp_dir}/events")
    page = Q.query_events(ev, severity="high", source="auth", start_time="2024-01-01 12:02:00",
                          end_time="2024-01-01 12:09:00", limit=2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan  # date partitions pruned
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "severity" in pushed and "source" in pushed and "timestamp" in pushed
    assert "TakeOrderedAndProject" in plan
    assert [r["id"] for r in page.collect()] == ["e5"]


def test_idempotent_insert_shuffles_incoming_once(spark, tmp_dir):
    import re as _re

    from vigil.operators.store import _stored_or_none, new_rows, to_stored_events
    from vigil.schema import STORED_EVENT
    ev = ten_events(spark)
    append_events(spark, ev.filter("source = 'syslog'"), f"{tmp_dir}/events")
    add = new_rows(to_stored_events(ev), _stored_or_none(spark, f"{tmp_dir}/events", STORED_EVENT))
    plan = add._jdf.queryExecution().executedPlan().toString()
    keys = _re.findall(r"(?m)^[\s:+|-]*Exchange hashpartitioning\(([^)]*)\)", plan)
    incoming = [k for k in keys if k.startswith("id#") and "event_date" in k]
    assert len(incoming) == 1  # first-wins aggregate and anti-join share the partitioning
    assert sorted(r["id"] for r in add.collect()) == [f"e{i}" for i in (1, 3, 5, 7, 9)]


def test_outbox_payload_is_whole_alert(spark, tmp_dir):
    import json

    ev = ten_events(spark)
    al = detect(ev, builtin_rules()).filter("event_id = 'e3'")
    outbox_sink(f"{tmp_dir}/outbox", "https://hooks.example/x", {"X-Key": "k"})(al, 7)
    row = spark.read.parquet(f"{tmp_dir}/outbox").collect()[0]
    p = json.loads(row["payload"])
    assert (row["url"], row["batch_id"], json.loads(row["headers"])) == ("https://hooks.example/x", 7, {"X-Key": "k"})
    assert p["rule_id"] == "gs-001" and p["severity"] == "high" and p["timestamp"].endswith("+00:00")
    assert p["event"]["id"] == "e3" and p["event"]["parsed_fields"]["user"] == "u3"


def test_alert_json_decodes_to_the_same_alert(spark):
    from vigil.operators.store import alert_from_json
    al = detect(ten_events(spark), builtin_rules())
    a = {r["id"]: r for r in al.collect()}
    for r in alert_from_json(alert_json(al)).collect():
        want = a[r["id"]]
        assert r["event"].asDict(True) == want["event"].asDict(True)
        assert (r["rule_id"], r["event_id"], r["timestamp"], r["description"]) == (
            want["rule_id"], want["event_id"], want["timestamp"], want["description"])


def test_decoders_default_what_is_missing(spark):
    from vigil.operators.store import alert_from_json
    df = spark.createDataFrame([('{"message": "m", "severity": "odd"}',)], "value string")
    e = event_from_json(df).collect()[0]
    assert (e["hostname"], e["severity"], e["raw"], e["parsed_fields"]) == ("unknown", "low", "m", {}) and len(e["id"]) == 64
    a = alert_from_json(spark.createDataFrame([('{"rule_id": "r", "event": {"message": "m"}}',)], "value string")).collect()[0]
    assert a["event"]["message"] == "m" and a["severity"] == "low" and len(a["id"]) == 64


def test_parsed_fields_named_like_the_lists_are_kept_once(spark, tmp_dir):
    import json

    from vigil.operators.store import to_stored_events
    rows = [{"message": "no address here", "id": "a", "parsed_fields": {"ip_addresses": "mine", "geo": "flat"}},
            {"message": "from 10.0.0.1", "id": "b", "parsed_fields": {"geo": "flat", "k": "v"}}]
    ev = normalize(events_df(spark, rows))
    texts = {r["id"]: r["parsed_json"] for r in to_stored_events(ev).collect()}
    for t in texts.values():
        keys = [k for k, _ in json.loads(t, object_pairs_hook=lambda p: p)]
        assert len(keys) == len(set(keys))
    append_events(spark, ev, f"{tmp_dir}/events")
    back = {r["id"]: r for r in read_events(spark, f"{tmp_dir}/events").collect()}
    assert back["a"]["parsed_fields"]["geo"] == "flat" and back["b"]["ip_addresses"] == ["10.0.0.1"]
    assert "10.0.0.1" in back["b"]["geo"] and back["b"]["parsed_fields"]["k"] == "v"


def test_console_emits_every_alert(spark):
    from vigil.operators.sinks import console_sink
    lines = []
    al = detect(ten_events(spark), builtin_rules())
    console_sink(lines.append)(al.unionByName(al).unionByName(al), 0)
    assert len(lines) == 30 and all("Failed SSH Login" in x for x in lines)


def test_summary_plans_hold_no_regex_and_read_few_columns(spark):
    from vigil.plans.queries import QUERIES
    for name, columns in [("events_by_severity", "struct<severity:string>"), ("events_per_hour", "struct<timestamp:timestamp>"),
                          ("top_rules", "struct<rule_name:string>"), ("stats_totals", "struct<>")]:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and f"ReadSchema: {columns}" in plan, (name, plan)
    plan = QUERIES["events_listing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(severity,high)" in plan and "event_date" in plan.split("PartitionFilters")[1][:60]


def test_detection_reads_typed_columns_equal_to_the_text(spark, tmp_dir):
    rows = [{"message": "a", "id": "a", "parsed_fields": {"user": "u", "ip_addresses": '["x"]', "geo": "near"}},
            {"message": "b", "id": "b", "parsed_fields": {"k": None, "geo": '{"1.2.3.4": {"type": "private"}}'}, "ip_addresses": []},
            {"message": "c", "id": "c", "parsed_fields": None, "ip_addresses": ["1.2.3.4", None]},
            {"message": "d", "id": "d", "parsed_fields": {"ip_addresses": "none", "geo": "x"}, "geo": {"5.6.7.8": {"type": "external", "country": None}}}]
    append_events(spark, events_df(spark, rows), f"{tmp_dir}/events")
    typed = {r["id"]: r for r in read_events(spark, f"{tmp_dir}/events").collect()}
    assert len(typed) == 4 and typed == {r["id"]: r for r in read_events(spark, f"{tmp_dir}/events", decode_text=True).collect()}
    assert typed["a"]["ip_addresses"] == ["x"] and typed["a"]["parsed_fields"] == {"user": "u", "geo": "near"}
    plan = detect(read_events(spark, f"{tmp_dir}/events"), builtin_rules())._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "parsed_json" not in plan


def test_pages_by_cursor_equal_pages_by_offset_and_read_few_days(spark, tmp_dir):
    from vigil.operators.store import table_dates
    # 40 days, most with 5 events (ties in time among them), some without; one day holds 60
    rows = [{"message": f"m{d}-{i}", "id": f"{d * 100 + i:05d}", "hostname": f"h{i % 3}",
             "timestamp": T0 + dt.timedelta(days=d, minutes=i // 2)} for d in range(40) if d % 7 != 3 for i in range(60 if d == 20 else 5)]
    append_events(spark, events_df(spark, rows), f"{tmp_dir}/events")
    table, dates = read_events(spark, f"{tmp_dir}/events"), table_dates(spark, f"{tmp_dir}/events")
    assert dates == sorted({(T0 + dt.timedelta(days=d)).date() for d in range(40) if d % 7 != 3}, reverse=True)
    for equal in ({}, {"hostname": "h1"}, {"hostname": "nobody"}):
        want = [r["id"] for r in Q.query_events(table, **equal, limit=1000).collect()]
        got, cursor = [], None
        while True:
            page = Q.page_after(table, dates, cursor, limit=23, equal=equal)
            ids = [r["id"] for r in page.collect()]
            got += ids
            if len(ids) < 23:
                break
            cursor = Q.page_cursor(page)
        assert got == want
    late = Q.page_after(table, dates, (int((T0 + dt.timedelta(days=30)).timestamp()) * 10**6, "z"), limit=10)
    plan = late._jdf.queryExecution().executedPlan().toString()
    oldest, newest = [re.search(rf"event_date#\d+ {op} (\d{{4}}-\d\d-\d\d)\)", plan.split("PartitionFilters: ")[1])[1] for op in (">=", "<=")]
    assert "2024-01-28" < oldest <= newest == "2024-01-31" and late.count() == 10
    assert Q.page_after(table, [], None).count() == 0 and Q.page_cursor(Q.page_after(table, [], None)) is None


def test_append_deals_whole_rows_once_and_a_date_has_few_files(spark, tmp_dir):
    """One exchange for first-wins, the join with stored ids and the write; without adaptive execution too (streams have none)."""
    import glob
    import re as _re

    from vigil.operators.store import SLICES, _stored_or_none, dealt_new_rows
    from vigil.schema import ALERT_NOT_NULL, STORED_ALERT
    from vigil.operators.store import append_alerts, to_stored_alerts
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    alerts = (spark.range(0, 4000, 1, 16).withColumn("timestamp", F.timestamp_seconds(F.lit(int(day.timestamp())) + F.col("id") % 3 * 86400))
              .select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("r").alias("rule_id"), F.lit("r").alias("rule_name"),
                      F.lit("low").alias("severity"), F.lit("e").alias("event_id"), "timestamp", F.lit("d").alias("description")))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert append_alerts(spark, alerts.unionByName(alerts).where("id < 'c'"), f"{tmp_dir}/alerts") == alerts.where("id < 'c'").count()
        files = glob.glob(f"{tmp_dir}/alerts/event_date=*/*.parquet")
        assert 3 <= len(files) <= 3 * SLICES
        add = dealt_new_rows(to_stored_alerts(alerts), _stored_or_none(spark, f"{tmp_dir}/alerts", STORED_ALERT), ALERT_NOT_NULL)
        assert len(_re.findall("Exchange", add._jdf.queryExecution().executedPlan().toString())) == 1
        assert append_alerts(spark, alerts, f"{tmp_dir}/alerts") == alerts.where("id >= 'c'").count()
        assert append_alerts(spark, alerts, f"{tmp_dir}/alerts") == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert spark.read.parquet(f"{tmp_dir}/alerts").select("id").distinct().count() == 4000


def test_append_reads_stored_ids_of_the_named_dates_only(spark, tmp_dir):
    ev = ten_events(spark)
    assert append_events(spark, ev, f"{tmp_dir}/events", [T0.date()]) == 10
    assert append_events(spark, ev, f"{tmp_dir}/events", [T0.date()]) == 0


def test_a_json_object_is_decoded_once_a_row(spark):
    """Its fields are read from one decoded object: a plan that decodes it field by field holds from_json for each."""
    from vigil.operators.store import alert_from_json
    rows = event_from_json(event_json(ten_events(spark)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(") == 1
    alerts = alert_from_json(spark.createDataFrame([('{"id": "a", "event": {"id": "e", "message": "m"}}',)], "value string"))
    r = alerts.first()
    assert (r["id"], r["event_id"], r["event"]["message"], r["event"]["hostname"]) == ("a", "e", "m", "unknown")
