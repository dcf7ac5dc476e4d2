import datetime as dt

from conftest import UTC, lines_df
from pyspark.sql import functions as F
from vigil.sources.lines import clean_lines, parse_auth, parse_syslog
from vigil.sources.ndjson import parse_ndjson
from vigil.sources.fanin import fan_in

NOW = dt.datetime(2026, 6, 1, 12, 0, 0, tzinfo=UTC)

AUTH_LINES = [
    "Apr 15 10:30:00 gate7 sshd[20411]: Failed password for invalid user mreyes from 198.51.100.7 port 40022 ssh2",
    "Apr 15 10:31:00 gate7 sshd[20412]: Accepted password for lkohl from 10.77.3.9 port 61002 ssh2",
    "Apr 15 10:32:00 gate7 sudo[20413]: lkohl : TTY=pts/4 ; PWD=/srv/jobs ; USER=postgres ; COMMAND=/usr/bin/pg_ctl reload",
    "Apr 15 10:33:00 gate7 useradd[20414]: new user: name=svc_batch, UID=2077, GID=2077, home=/srv/batch",
    "Apr 15 10:34:00 gate7 userdel[20415]: delete user 'intern04'",
    "Apr 15 10:35:00 gate7 sshd[20416]: Failed password for oper from 192.168.40.2 port 50111 ssh2",
    "a line of some other form",
    "",
    "   ",
]


def auth_rows(spark):
    df = clean_lines(lines_df(spark, AUTH_LINES))
    return {r["raw"]: r for r in parse_auth(df, "value", "auth", year=2026, now=NOW).collect()}


def test_auth_lines(spark):
    rows = auth_rows(spark)
    assert len(rows) == 6  # invalid, empty and blank lines dropped
    r = rows[AUTH_LINES[0]]
    pf = r["parsed_fields"]
    assert r["severity"] == "high" and pf["event_type"] == "ssh_failed"
    assert (pf["user"], pf["src_ip"], pf["port"], pf["process"], pf["pid"]) == ("mreyes", "198.51.100.7", "40022", "sshd", "20411")
    assert r["hostname"] == "gate7" and r["source"] == "auth"
    assert r["timestamp"].replace(tzinfo=UTC) == dt.datetime(2026, 4, 15, 10, 30, tzinfo=UTC)
    r = rows[AUTH_LINES[1]]["parsed_fields"]
    assert (r["event_type"], r["user"], r["src_ip"], r["port"]) == ("ssh_accepted", "lkohl", "10.77.3.9", "61002")
    assert rows[AUTH_LINES[1]]["severity"] == "medium"
    r = rows[AUTH_LINES[2]]["parsed_fields"]
    assert (r["event_type"], r["user"], r["target_user"], r["pwd"], r["command"]) == (
        "sudo", "lkohl", "postgres", "/srv/jobs", "/usr/bin/pg_ctl reload")
    r = rows[AUTH_LINES[3]]
    assert r["parsed_fields"]["event_type"] == "user_created" and r["parsed_fields"]["user"] == "svc_batch"
    assert r["severity"] == "high"
    r = rows[AUTH_LINES[4]]
    assert r["parsed_fields"]["event_type"] == "user_deleted" and r["parsed_fields"]["user"] == "intern04"
    r = rows[AUTH_LINES[5]]["parsed_fields"]
    assert (r["user"], r["src_ip"]) == ("oper", "192.168.40.2")


def test_header_without_pid_and_unicode_strip(spark):
    df = clean_lines(lines_df(spark, ["　\x1cApr  5 01:02:03 host cron: job done \t"]))
    r = parse_syslog(df, "value", "syslog", year=2026, now=NOW).collect()[0]
    assert r["parsed_fields"] == {"process": "cron"}
    assert r["message"] == "job done"
    assert r["timestamp"].replace(tzinfo=UTC) == dt.datetime(2026, 4, 5, 1, 2, 3, tzinfo=UTC)


def test_syslog_severity_and_bad_time(spark):
    df = lines_df(spark, [
        "Jan 10 00:00:00 h app[1]: Error: disk failure",
        "Jan 10 00:00:01 h app[1]: connection timeout",
        "Jan 10 00:00:02 h app[1]: all good",
        "Xyz 10 00:00:03 h app[1]: unknown month word",
        "Feb 29 00:00:04 h app[1]: leap day",
    ])
    rows = parse_syslog(df, "value", "syslog", year=2026, now=NOW).orderBy("raw").collect()
    by_msg = {r["message"]: r for r in rows}
    assert by_msg["Error: disk failure"]["severity"] == "high"
    assert by_msg["connection timeout"]["severity"] == "medium"
    assert by_msg["all good"]["severity"] == "low"
    assert by_msg["unknown month word"]["timestamp"].replace(tzinfo=UTC) == NOW  # unparsable -> now
    assert by_msg["leap day"]["timestamp"].replace(tzinfo=UTC) == NOW  # 2026 is not a leap year


def test_json_lines(spark):
    df = lines_df(spark, [
        '{"timestamp": null, "time": "2026-04-15T10:00:00Z", "msg": "a", "level": "error"}',
        '{"time": "2026-04-15T12:00:00+02:00", "host": "h1", "message": "b", "severity": "High", "source": "app"}',
        '{"@timestamp": 1776247200, "msg": "c", "level": "informational"}',
        '{"time": "2026-04-15 10:00:00.250000", "msg": "d", "level": "CRITICAL", "nested": {"x": [1, 2]}}',
        '[1, 2, 3]',
        'not json at all',
        '{"time": "garbage", "level": ""}',
        '{"time": "20260415T120000+0200", "msg": "basic form"}',
    ])
    rows = {r["raw"][:22]: r for r in parse_ndjson(df, "value", "json", now=NOW).collect()}
    assert len(rows) == 6
    f = rows['{"time": "20260415T120']
    assert f["timestamp"].replace(tzinfo=UTC) == dt.datetime(2026, 4, 15, 10, 0, tzinfo=UTC)
    a = rows['{"timestamp": null, "t']
    assert a["timestamp"].replace(tzinfo=UTC) == NOW  # first present key wins, even when null
    assert a["severity"] == "low" and a["hostname"] == "unknown" and a["source"] == "json"
    b = rows['{"time": "2026-04-15T1']
    assert b["timestamp"].replace(tzinfo=UTC) == dt.datetime(2026, 4, 15, 10, 0, tzinfo=UTC)
    assert (b["severity"], b["hostname"], b["source"], b["message"]) == ("high", "h1", "app", "b")
    c = rows['{"@timestamp": 1776247']
    assert c["timestamp"].replace(tzinfo=UTC) == dt.datetime(2026, 4, 15, 10, 0, tzinfo=UTC)
    assert c["severity"] == "low"
    d = rows['{"time": "2026-04-15 1']
    assert d["timestamp"].replace(tzinfo=UTC) == dt.datetime(2026, 4, 15, 10, 0, 0, 250000, tzinfo=UTC)
    assert d["severity"] == "critical" and d["parsed_fields"]["nested"] == '{"x":[1,2]}'
    e = rows['{"time": "garbage", "l']
    assert e["timestamp"].replace(tzinfo=UTC) == NOW and e["severity"] == "low"
    assert e["message"] == '{"time": "garbage", "level": ""}'  # no message key: the object's JSON text


def test_json_custom_field_map(spark):
    df = lines_df(spark, ['{"when": "2026-01-01T00:00:00Z", "text": "x", "box": "b1"}'])
    fm = {"when": "timestamp", "text": "message", "box": "hostname"}
    r = parse_ndjson(df, "value", "json", field_map=fm, now=NOW).collect()[0]
    assert (r["message"], r["hostname"]) == ("x", "b1")
    assert r["timestamp"].replace(tzinfo=UTC) == dt.datetime(2026, 1, 1, tzinfo=UTC)


def test_fan_in_skips_bad_sources(spark):
    a = lines_df(spark, AUTH_LINES[:2])
    s = lines_df(spark, ["Jan 10 00:00:00 h app[1]: hello"])
    ev = fan_in(spark, [
        {"type": "auth", "name": "auth", "lines": a, "year": 2026},
        {"type": "nope"},
        {"name": "no type"},
        {"type": "syslog", "name": "sys", "lines": s, "year": 2026},
        {"type": "json", "path": "/nonexistent/path/x.json"},
    ])
    got = sorted(r["source"] for r in ev.select("source").collect())
    assert got == ["auth", "auth", "sys"]


def test_file_reader_ids_are_deterministic(spark, tmp_dir):
    from vigil.sources.lines import read_auth
    p = f"{tmp_dir}/auth.log"
    with open(p, "w") as fh:
        fh.write("\n".join(AUTH_LINES[:2] + [AUTH_LINES[0]]) + "\n")
    ids1 = sorted(r["id"] for r in read_auth(spark, p, year=2026).select("id").collect())
    ids2 = sorted(r["id"] for r in read_auth(spark, p, year=2026).repartition(3).select("id").collect())
    assert ids1 == ids2 and len(set(ids1)) == 3  # the repeated line keeps its own id


def test_feb29_in_leap_year(spark):
    df = lines_df(spark, ["Feb 29 12:00:00 h app[1]: leap"])
    r = parse_syslog(df, "value", "syslog", year=2024, now=NOW).collect()[0]
    assert r["timestamp"].replace(tzinfo=UTC) == dt.datetime(2024, 2, 29, 12, tzinfo=UTC)


def test_equal_lines_are_numbered_with_one_exchange_and_one_scan(spark, tmp_dir):
    from collections import Counter

    from pyspark.sql import functions as F

    from vigil.sources.lines import event_id, numbered_lines, read_text_lines
    rows = [("f1", "hot line")] * 5000 + [("f1", f"line {i}") for i in range(300)] + [("f2", "hot line")] * 7
    df = spark.createDataFrame(rows, "file_path string, value string").repartition(8)
    got = sorted((r["value"], r["id"]) for r in numbered_lines(df, "c").collect())
    want = [(f, v, i) for (f, v), n in Counter(rows).items() for i in range(1, n + 1)]
    ids = spark.createDataFrame(want, "f string, v string, i int").select(
        "v", event_id(F.lit("c"), F.col("f"), F.col("v"), F.col("i")).alias("id"))
    assert got == sorted((r["v"], r["id"]) for r in ids.collect()) and len({i for _, i in got}) == len(rows)
    p = f"{tmp_dir}/a.log"
    with open(p, "w") as fh:
        fh.write("x\ny\nx\n")
    plan = numbered_lines(read_text_lines(spark, p), "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan text") == 1


def test_ids_do_not_depend_on_a_mapped_source(spark, tmp_dir):
    from vigil.sources.ndjson import read_ndjson
    p = f"{tmp_dir}/a.json"
    with open(p, "w") as fh:
        fh.write('{"msg": "m", "source": "elsewhere"}\n{"msg": "n"}\n')
    a = {r["message"]: r for r in read_ndjson(spark, p, now=NOW).collect()}
    b = {r["message"]: r for r in read_ndjson(spark, p, field_map={"msg": "message"}, now=NOW).collect()}
    assert a["m"]["source"] == "elsewhere" and b["m"]["source"] == "json" and a["m"]["id"] == b["m"]["id"]


def test_a_source_that_fails_while_read_leaves_the_others(spark, tmp_dir):
    import os

    from vigil.sources.fanin import fan_in_staged
    for name in ("good", "bad"):
        os.makedirs(f"{tmp_dir}/{name}")
    with open(f"{tmp_dir}/good/a.log", "w") as f:
        f.write("Apr 02 08:00:00 gate7 sshd[77]: up\n" * 3)
    with open(f"{tmp_dir}/bad/a.log.gz", "wb") as f:
        f.write(b"no gzip")
    configs = [{"type": "syslog", "path": f"{tmp_dir}/bad", "name": "bad", "year": 2024}, {"type": "syslog", "path": f"{tmp_dir}/good", "year": 2024}, {"name": "none"}]
    events, failures = fan_in_staged(spark, configs, f"{tmp_dir}/staged")
    assert events.count() == 3 and events.select("id").distinct().count() == 3
    rows = {r["source"]: r for r in failures.collect()}
    assert set(rows) == {"bad", "none"} and rows["bad"]["path"].endswith("/bad") and rows["bad"]["error"]
    assert fan_in_staged(spark, configs[:1], f"{tmp_dir}/again")[0] is None


def test_partitions_of_an_aggregation_grow_with_the_input(spark, tmp_dir):
    """Rows are dealt to partitions in number of the input's splits, each key to one of them, whatever shuffle.partitions says."""
    from vigil.functions.partitioning import spread_by_input
    spark.range(0, 100, 1, 5).selectExpr("cast(id as string) value").write.text(f"{tmp_dir}/t")
    read = spark.read.text(f"{tmp_dir}/t")
    dealt = spread_by_input(read.unionByName(read), [read, read], "value", per_split=3)
    assert dealt.rdd.getNumPartitions() == 6 * read.rdd.getNumPartitions()
    held = dealt.rdd.mapPartitionsWithIndex(lambda i, rows: [(r["value"], i) for r in rows]).distinct().collect()
    assert len(held) == 100


def test_auth_lines_without_a_patterns_text_are_not_searched_for_it(spark):
    """A long word is read once, not from each of its places; every pattern still finds what it found before."""
    import time

    from vigil.functions.text import group_at, regex_split
    from vigil.sources.lines import AUTH_GROUPS, with_auth_matches
    texts = ["Failed password for invalid user bob from 10.0.0.1 port 22 ssh2", "x: Failed password for al from h port 1",
             "Failed password for", "Accepted publickey for al from ::1 port 9", "Accepted token for al from ::1 port 9",
             "al : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls -l", "a:TTY=x;PWD=y;USER=z;COMMAND=c", "TTY=pts/0 ; PWD=/",
             "new user: name=eve, UID=7", "new user: name=eve", "delete user 'eve'", "delete user eve", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "message string")
    fields = [(p, pattern, n, i + 1) for p, pattern, n in AUTH_GROUPS for i in range(n)]
    guarded = with_auth_matches(rows, F.col("message")).select("message", *[group_at(F.col("_m")[p], i).alias(f"{p}{i}") for p, _, _, i in fields])
    plain = rows.select("message", *[group_at(regex_split(F.col("message"), pattern, n), i).alias(f"{p}{i}") for p, pattern, n, i in fields])
    assert sorted(map(str, guarded.collect())) == sorted(map(str, plain.collect()))

    lines = lines_df(spark, ["Mar  1 10:00:00 web01 app[1]: " + "x" * 60_000 + str(i) for i in range(64)])
    start = time.monotonic()
    assert parse_auth(lines, year=2024).agg(F.sum(F.length("message"))).first()[0] > 64 * 60_000
    got = parse_auth(lines, year=2024).select("parsed_fields").collect()
    assert time.monotonic() - start < 40
    assert all(set(r[0]) == {"process", "pid"} for r in got)
