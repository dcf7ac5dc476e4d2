import datetime as dt
import os

from pyspark.sql import functions as F

from vigil.operators.builtin import builtin_rules
from vigil.operators.dedup import dedup
from vigil.operators.detect import detect
from vigil.operators.normalize import normalize
from vigil.operators.store import append_events, read_alerts, read_events
from vigil.sources import derived
from vigil.sources.lines import read_auth
from vigil.sources.ndjson import read_ndjson
from vigil.streaming.live import follow, live_source, run_to_end, start_live, stream_alerts, stream_stored_events
from vigil.streaming.stateful import observe_stats, stream_dedup

SF = "/root/testdata/sf0.001"


def write_files(spark, folder, chunks=4):
    """The derived auth lines, in time order, cut into files with rising mtimes."""
    v = derived.log_view(spark, SF).filter("source = 'auth'").select("event_id", "line").orderBy("event_id").toPandas()
    os.makedirs(folder)
    n = len(v)
    for i in range(chunks):
        p = f"{folder}/auth_{i:03d}.log"
        with open(p, "w") as fh:
            fh.write("\n".join(v.line.iloc[i * n // chunks:(i + 1) * n // chunks]) + "\n")
        os.utime(p, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))


def test_stream_equals_batch(spark, tmp_dir):
    """Stored events streamed file by file give the batch's alerts and dispatch flags."""
    write_files(spark, f"{tmp_dir}/in")
    batch_ev = normalize(read_auth(spark, f"{tmp_dir}/in", year=2024, now=derived.FALLBACK))
    parts = sorted(os.listdir(f"{tmp_dir}/in"))
    for f in parts:  # one append a file: the events table is a folder of several files
        append_events(spark, normalize(read_auth(spark, f"{tmp_dir}/in/{f}", year=2024, now=derived.FALLBACK)), f"{tmp_dir}/events")
    al = detect(batch_ev, builtin_rules())
    want = {r["id"]: r["dispatched"] for r in dedup(al, 300).collect()}
    assert len(want) == al.count() and {r["rule_id"] for r in al.collect()} >= {"gs-001", "gs-002"}
    for files in (None, 1):
        ev = stream_stored_events(spark, f"{tmp_dir}/events", files).withWatermark("timestamp", "30 days")
        out = run_to_end(stream_alerts(ev, builtin_rules()).select("id"), "alerts")
        assert sorted(r["id"] for r in out.collect()) == sorted(want)
    ev = stream_stored_events(spark, f"{tmp_dir}/events").withWatermark("timestamp", "30 days")
    out = run_to_end(stream_dedup(stream_alerts(ev, builtin_rules()), 300).select("id", "dispatched"), "dedup")
    assert {r["id"]: r["dispatched"] for r in out.collect()} == want


def test_files_out_of_order_give_the_batch_alerts(spark, tmp_dir):
    """Rows inside the watermark that come in later micro-batches than newer ones are counted, and fire what they complete."""
    text = "Apr 02 {:02d}:{:02d}:{:02d} gate7 sshd[77]: Failed password for oper from 198.51.100.9 port 4000 ssh2\n"
    times = [(8, m, s) for m in (0, 30) for s in range(0, 30, 5)] + [(h, 0, 0) for h in (9, 12, 15)]
    os.makedirs(f"{tmp_dir}/in")
    for i, part in enumerate([(14, 8, 11), (2, 5, 13, 4), (0, 7, 10, 12), (1, 3, 6, 9)]):
        with open(f"{tmp_dir}/in/{i:02d}.log", "w") as fh:
            fh.writelines(text.format(*times[at]) for at in part)
    whole = normalize(read_auth(spark, f"{tmp_dir}/in", year=2024, now=derived.FALLBACK))
    want = sorted(r["id"] for r in detect(whole, builtin_rules()).where("rule_id = 'gs-002'").collect())
    assert len(want) == 4
    for f in sorted(os.listdir(f"{tmp_dir}/in")):
        append_events(spark, normalize(read_auth(spark, f"{tmp_dir}/in/{f}", year=2024, now=derived.FALLBACK)), f"{tmp_dir}/events")
    ev = stream_stored_events(spark, f"{tmp_dir}/events", 1).withWatermark("timestamp", "1 day")
    got = run_to_end(stream_alerts(ev, builtin_rules()).where("rule_id = 'gs-002'").select("id"), "late")
    assert sorted(r["id"] for r in got.collect()) == want


def test_an_earlier_alert_in_a_later_batch_is_dispatched(spark, tmp_dir):
    text = "Apr 02 {:02d}:{:02d}:00 gate7 sshd[77]: Accepted password for oper from 10.1.1.1 port 4 ssh2\n"
    os.makedirs(f"{tmp_dir}/in")
    for i, at in enumerate([(12, 0), (8, 0), (8, 2), (12, 3), (7, 0)]):
        with open(f"{tmp_dir}/in/{i}.log", "w") as fh:
            fh.write(text.format(*at))
        append_events(spark, normalize(read_auth(spark, f"{tmp_dir}/in/{i}.log", year=2024)), f"{tmp_dir}/events")
    whole = normalize(read_auth(spark, f"{tmp_dir}/in", year=2024))
    want = {r["id"]: r["dispatched"] for r in dedup(detect(whole, builtin_rules()), 300).collect()}
    assert sorted(want.values()) == [False, False, True, True, True]
    ev = stream_stored_events(spark, f"{tmp_dir}/events", 1).withWatermark("timestamp", "1 day")
    got = run_to_end(stream_dedup(stream_alerts(ev, builtin_rules()), 300).select("id", "dispatched"), "late-dedup")
    assert {r["id"]: r["dispatched"] for r in got.collect()} == want


def run_live(spark, sources, base, **kw):
    qs = start_live(spark, sources, f"{base}/events", f"{base}/alerts", f"{base}/ck", watermark="30 days", trigger_seconds=0, **kw)
    try:
        for q in qs:
            q.processAllAvailable()
    finally:
        for q in qs:
            q.stop()
    return qs


def test_live_equals_batch_with_repeated_lines_and_mapped_sources(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/auth")
    os.makedirs(f"{tmp_dir}/json")
    line = "Apr 02 08:00:0{} gate7 sshd[77]: Failed password for oper from 198.51.100.9 port 4000 ssh2\n"
    with open(f"{tmp_dir}/auth/a.log", "w") as fh:
        fh.write(line.format(1) * 6 + line.format(2) + "Apr 02 08:00:03 gate7 sshd[77]: Accepted password for oper from 10.1.1.1 port 4 ssh2\n")
    with open(f"{tmp_dir}/json/a.json", "w") as fh:
        fh.write('{"time": "2024-04-02T09:00:00Z", "msg": "curl of a dump", "source": "elsewhere"}\n' * 3)
        fh.write('{"time": "2024-04-02T09:00:01Z", "msg": null}\n')
    sent = []
    now = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    sources = [live_source(spark, f"{tmp_dir}/auth", "auth", year=2024, now=now), live_source(spark, f"{tmp_dir}/json", "json", now=now)]
    run_live(spark, sources, tmp_dir, sinks=[lambda df, i: sent.extend(r["id"] for r in df.collect())])
    batch = normalize(read_auth(spark, f"{tmp_dir}/auth", year=2024, now=now)).unionByName(
        normalize(read_ndjson(spark, f"{tmp_dir}/json", now=now)), allowMissingColumns=True).where("message is not null")
    al = detect(batch, builtin_rules())
    want = sorted(r["id"] for r in al.collect())
    stored = read_alerts(spark, f"{tmp_dir}/alerts")
    assert sorted(r["id"] for r in stored.collect()) == want and len(want) == 7 + 3 + 1 + 3
    events = read_events(spark, f"{tmp_dir}/events")
    assert events.count() == 11 and stored.join(events.select(F.col("id").alias("event_id")), "event_id").count() == len(want)
    assert sorted(sent) == sorted(r["id"] for r in dedup(al, 300).where("dispatched").collect())
    assert spark.read.text(f"{tmp_dir}/events_quarantine").count() == 1  # never dropped
    # a restart on the same folders replays nothing
    run_live(spark, sources, tmp_dir)
    assert read_events(spark, f"{tmp_dir}/events").count() == 11 and read_alerts(spark, f"{tmp_dir}/alerts").count() == len(want)


def test_late_events_still_raise_plain_alerts(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/auth")
    text = "Apr {:02d} 08:00:00 gate7 sshd[77]: Accepted password for oper from 10.1.1.{} port 4 ssh2\n"
    source = live_source(spark, f"{tmp_dir}/auth", "auth", year=2024, max_files_per_trigger=1)
    for i, day in enumerate((20, 21, 2)):  # the last file is 19 days late
        with open(f"{tmp_dir}/auth/{i}.log", "w") as fh:
            fh.write(text.format(day, i))
        os.utime(f"{tmp_dir}/auth/{i}.log", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
        qs = start_live(spark, [source], f"{tmp_dir}/events", f"{tmp_dir}/alerts", f"{tmp_dir}/ck", watermark="1 minute", trigger_seconds=0)
        for q in qs:
            q.processAllAvailable()
        for q in qs:
            q.stop()
    assert read_events(spark, f"{tmp_dir}/events").count() == 3
    assert read_alerts(spark, f"{tmp_dir}/alerts").count() == 3


def test_observed_statistics(spark, tmp_dir):
    ev = normalize(read_auth_lines(spark, tmp_dir))
    append_events(spark, ev, f"{tmp_dir}/events")
    stream = stream_stored_events(spark, f"{tmp_dir}/events").withWatermark("timestamp", "30 days")
    flagged = observe_stats(stream_dedup(stream_alerts(stream, builtin_rules()), 300), "stats", handlers=2)
    q = flagged.writeStream.format("noop").option("checkpointLocation", f"{tmp_dir}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [p["observedMetrics"]["stats"] for p in q.recentProgress if "stats" in p["observedMetrics"]]
    assert sum(m["total_dispatched"] for m in seen) == 1 and sum(m["total_suppressed"] for m in seen) == 3


def read_auth_lines(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/one")
    with open(f"{tmp_dir}/one/a.log", "w") as fh:
        for i in range(4):
            fh.write(f"Apr 02 08:00:0{i} gate7 sshd[77]: Accepted password for oper from 10.1.1.1 port 4 ssh2\n")
    return read_auth(spark, f"{tmp_dir}/one", year=2024)


def test_stream_events_per_hour(spark, tmp_dir):
    from vigil.streaming.live import run_to_end, stream_events_per_hour
    os.makedirs(f"{tmp_dir}/in")
    for f, hours in enumerate([(0, 1), (1, 2), (3, 4)]):
        p = f"{tmp_dir}/in/s{f}.log"
        with open(p, "w") as fh:
            for h in hours:
                for m in range(0, 60, 7 + h):
                    fh.write(f"Jan 01 {h:02d}:{m:02d}:00 host app[1]: tick {h} {m}\n")
        os.utime(p, (1_700_000_000 + f, 1_700_000_000 + f))
    ev = follow(spark, f"{tmp_dir}/in", "syslog", year=2024, max_files_per_trigger=1)
    got = {r["hour"]: r["count"] for r in run_to_end(stream_events_per_hour(ev, "0 seconds"), "eph").collect()}
    from vigil.sources.lines import read_syslog
    batch = {r["hour"]: r["count"] for r in read_syslog(spark, f"{tmp_dir}/in", year=2024)
             .groupBy(F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd HH:00").alias("hour"))
             .count().collect()}
    # append mode emits an hour once the watermark has passed its end: every
    # closed hour equals the batch count; the last hour is still open
    assert set(got) == set(batch) - {max(batch)}
    assert all(got[h] == batch[h] for h in got)


def test_follow_only_new_files(spark, tmp_dir):
    import datetime as dt

    from vigil.streaming.live import run_to_end
    os.makedirs(f"{tmp_dir}/in")
    for i, mtime in enumerate([1_600_000_000, 1_800_000_000]):
        p = f"{tmp_dir}/in/f{i}.log"
        with open(p, "w") as fh:
            fh.write(f"Jan 01 00:00:0{i} host app[1]: line from file {i}\n")
        os.utime(p, (mtime, mtime))
    start = dt.datetime.fromtimestamp(1_700_000_000, dt.timezone.utc)
    ev = follow(spark, f"{tmp_dir}/in", "syslog", start_time=start, year=2024)
    got = [r["message"] for r in run_to_end(ev.select("message"), "follow").collect()]
    assert got == ["line from file 1"]


def test_hours_are_upserted_and_leave_the_state(spark, tmp_dir):
    """Thirty days, one file a day: every hour's last count is the batch's, and the state holds only the open hours."""
    from vigil.streaming.live import read_hours, stream_events_per_hour, upsert_hours
    os.makedirs(f"{tmp_dir}/in")
    for d in range(1, 31):
        with open(f"{tmp_dir}/in/{d:02d}.log", "w") as fh:
            fh.writelines(f"Apr {d:02d} {h:02d}:{m:02d}:00 host app[1]: tick\n" for h in range(24) for m in range(0, 60, 7 + d % 5))
        os.utime(f"{tmp_dir}/in/{d:02d}.log", (1_700_000_000 + d, 1_700_000_000 + d))
    ev = follow(spark, f"{tmp_dir}/in", "syslog", year=2024, max_files_per_trigger=3)
    q = upsert_hours(stream_events_per_hour(ev, "1 hour"), f"{tmp_dir}/out", f"{tmp_dir}/ck", availableNow=True)
    q.awaitTermination()
    from vigil.sources.lines import read_syslog
    batch = {r["hour"]: r["count"] for r in read_syslog(spark, f"{tmp_dir}/in", year=2024)
             .groupBy(F.date_format("timestamp", "yyyy-MM-dd HH:00").alias("hour")).count().collect()}
    assert {r["hour"]: r["count"] for r in read_hours(spark, f"{tmp_dir}/out").collect()} == batch and len(batch) == 720
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 3 * 24 + 3 and held[-1] <= 3
