"""Registered queries: one per operator of the inventory, each reading the
driver's tables (``events`` through the derived log view, ``documents``)
whole, and each paired with an independent DuckDB oracle in ``SQL``. Queries over stored events and alerts read the
tables that ``logview.stored_tables`` writes to the shared folder.

Every computed column is aliased to the same name on both sides.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.partitioning import spread_by_input
from vigil.operators import query as Q
from vigil.operators.builtin import builtin_rule, builtin_rules
from vigil.operators.dedup import dedup, dispatch_stats, dispatched
from vigil.operators.detect import detect
from vigil.operators.normalize import normalize
from vigil.operators.rules import load_rule
from vigil.operators.sinks import alert_json, console_records, fan_out, file_sink, outbox_sink
from vigil.operators.store import (alert_from_json, append_events, event_from_json, event_json, read_alerts, read_events,
                                   stored_schema, table_dates)
from vigil.plans import oracle as O
from vigil.plans.batch import detect_stored
from vigil.plans.logview import stored_tables, view_events
from vigil.schema import EVENT_COLUMNS, STORED_EVENT
from vigil.session import ensure_checkpoint_dir
from vigil.sources import derived
from vigil.sources.fanin import fan_in, fan_in_staged
from vigil.sources.lines import clean_lines, parse_auth, parse_syslog
from vigil.sources.ndjson import parse_ndjson
from vigil.streaming.live import (appended_source, live_source, read_hours, run_to_end, start_alerts, start_events, start_live,
                                  stream_alerts, stream_events_per_hour, stream_stored_events, to_end, upsert_hours)
from vigil.streaming.stateful import stream_dedup

UTC = _dt.timezone.utc
# Fixed clock for the "last 24 hours" statistic: the derived log clock starts
# 2024-01-01 00:00 and runs 2 s per event, so the 24 h boundary cuts the data.
STATS_NOW = _dt.datetime(2024, 1, 2, 2, 0, 0, tzinfo=UTC)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def ts_us(c: str = "timestamp") -> Column:
    return F.unix_micros(F.col(c))


def geo_text(geo: Column) -> Column:
    entries = F.transform(F.map_entries(geo), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["type"], F.lit("/"), e["value"]["country"]))
    return F.when(geo.isNotNull(), F.array_join(F.array_sort(entries), ","))


def norm_cols(pf: str = "parsed_fields") -> list[Column]:
    return [
        F.when(F.size("ip_addresses") > 0, F.array_join("ip_addresses", ",")).alias("ip_list"),
        F.col(pf)["src_ip"].alias("src_ip"),
        F.col(pf)["user"].alias("usr"),
        F.col(pf)["process"].alias("process"),
        F.col("severity"),
        geo_text(F.col("geo")).alias("geo_text"),
    ]


# --------------------------------------------------------------------- sources
@register("syslog_parse", O.with_events("""
SELECT event_id, line_us AS ts_us,
       hostname, process, pid, base_severity AS severity, message
FROM p WHERE source = 'syslog'"""))
def syslog_parse(spark, sf):
    lines = clean_lines(derived.log_lines(spark, sf, "syslog").withColumnRenamed("event_id", "seq").drop("source"))
    ev = parse_syslog(lines, "value", "syslog", year=derived.LOG_YEAR, now=derived.FALLBACK)
    return ev.select(F.col("seq").alias("event_id"), ts_us().alias("ts_us"), "hostname",
                     F.col("parsed_fields")["process"].alias("process"), F.col("parsed_fields")["pid"].alias("pid"),
                     "severity", "message")


@register("auth_parse", O.with_events("""
SELECT event_id, line_us AS ts_us,
       hostname, process, pid, event_type, p_user AS usr, p_src_ip AS src_ip, port, target_user, command, pwd,
       base_severity AS severity, message
FROM p WHERE source = 'auth'"""))
def auth_parse(spark, sf):
    lines = clean_lines(derived.log_lines(spark, sf, "auth").withColumnRenamed("event_id", "seq").drop("source"))
    ev = parse_auth(lines, "value", "auth", year=derived.LOG_YEAR, now=derived.FALLBACK)
    pf = F.col("parsed_fields")
    return ev.select(F.col("seq").alias("event_id"), ts_us().alias("ts_us"), "hostname",
                     pf["process"].alias("process"), pf["pid"].alias("pid"), pf["event_type"].alias("event_type"),
                     pf["user"].alias("usr"), pf["src_ip"].alias("src_ip"), pf["port"].alias("port"),
                     pf["target_user"].alias("target_user"), pf["command"].alias("command"),
                     pf["pwd"].alias("pwd"), "severity", "message")


# The JSON lines carry the table's own time; what each form means is written out here again.
_JSON_EVENTS = f"""
v AS ({derived.duck_log_view_sql()}),
j AS (SELECT * FROM ({derived.duck_json_sql()})),
je AS (
  SELECT event_id,
    CASE WHEN event_id % 8 IN (0, 1, 2, 3, 7) THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us({derived.FALLBACK_SQL}) END AS ts_us,
    CASE WHEN event_id % 7 = 3 THEN 'mapped' ELSE 'json' END AS source,
    CASE WHEN event_id % 3 = 2 THEN 'unknown' ELSE hostname END AS hostname,
    CASE WHEN event_id % 9 IN (7, 8) THEN 'low' WHEN message LIKE 'Failed%' THEN 'low' WHEN message LIKE 'Accepted%' THEN 'high'
         WHEN message LIKE '%COMMAND=%' THEN 'medium' WHEN process = 'useradd' THEN 'critical' ELSE 'low' END AS severity,
    CASE WHEN event_id % 5 = 4 THEN j.line ELSE message END AS message, CAST(event_id AS VARCHAR) AS pid, props
  FROM v JOIN j USING (event_id))"""


def _json_events(spark, sf):
    return parse_ndjson(clean_lines(derived.json_lines(spark, sf)), "value", "json", now=derived.FALLBACK)


@register("json_parse", f"WITH {_JSON_EVENTS}\nSELECT event_id, ts_us, source, hostname, severity, message, pid, "
                        "regexp_extract(props, '([0-9]+)', 1) AS k FROM je")
def json_parse(spark, sf):
    ev = _json_events(spark, sf)
    return ev.select("event_id", ts_us().alias("ts_us"), "source", "hostname", "severity", "message",
                     F.col("parsed_fields")["pid"].alias("pid"),
                     F.coalesce(F.regexp_extract(F.col("parsed_fields")["props"], "([0-9]+)", 1), F.lit("")).alias("k"))


@register("json_field_map", f"WITH {_JSON_EVENTS}\nSELECT event_id, pid AS hostname, "
                            "CASE WHEN event_id % 3 = 2 THEN j.line ELSE hostname END AS message FROM je JOIN j USING (event_id)")
def json_field_map(spark, sf):
    """A field map of one's own: other keys, other targets, none for the time. A line without the message's key (every third
    has no host) is its own message."""
    ev = parse_ndjson(clean_lines(derived.json_lines(spark, sf)), "value", "own", {"pid": "hostname", "host": "message"}, now=derived.FALLBACK)
    return ev.select("event_id", "hostname", "message")


@register("source_fanin", O.with_events(f"""
{_JSON_EVENTS.replace('v AS (', 'v2 AS (', 1).replace('FROM v JOIN', 'FROM v2 JOIN')}
SELECT event_id, source, hostname, base_severity AS severity FROM p
UNION ALL
SELECT event_id, CASE source WHEN 'json' THEN 'app' ELSE source END AS source, hostname, severity FROM je"""))
def source_fanin(spark, sf):
    lines = clean_lines(derived.log_lines(spark, sf))
    configs = [
        {"type": "syslog", "name": "syslog", "lines": lines.filter("source = 'syslog'").drop("source"),
         "year": derived.LOG_YEAR},
        {"type": "auth", "name": "auth", "lines": lines.filter("source = 'auth'").drop("source"),
         "year": derived.LOG_YEAR},
        {"type": "json", "name": "app", "lines": derived.json_lines(spark, sf)},
        {"type": "no-such-source", "path": "/nonexistent"},  # skipped with a warning
        {"name": "typeless"},  # skipped with a warning
    ]
    ev = fan_in(spark, configs)
    return ev.select("event_id", "source", "hostname", "severity")


@register("source_isolation", O.with_events("""
SELECT source, CAST(count(*) AS BIGINT) AS events, CAST(NULL AS VARCHAR) AS failed FROM p GROUP BY source
UNION ALL SELECT * FROM (VALUES ('broken', 0, 'syslog'), ('missing', 0, 'json'), ('odd', 0, 'no-such-source')) AS f(source, events, failed)"""))
def source_isolation(spark, sf):
    """A5: sources that fail while they are read (a file that is not what its name says, a path that is not there) leave the
    others' events, and a row each."""
    from pyarrow import fs
    folder = f"{ensure_checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = derived.log_lines(spark, sf)
    for kind in ("syslog", "auth"):
        lines.where(F.col("source") == kind).select("value").write.text(f"{folder}/{kind}")
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{base}/broken")
    with files.open_output_stream(f"{base}/broken/a.log.gz", compression=None) as f:
        f.write(b"this is no compressed file")
    own = {"year": derived.LOG_YEAR, "now": derived.FALLBACK}
    events, failures = fan_in_staged(spark, [
        {"type": "syslog", "path": f"{folder}/syslog", **own}, {"type": "syslog", "name": "broken", "path": f"{folder}/broken", **own},
        {"type": "json", "name": "missing", "path": f"{folder}/nowhere"}, {"type": "no-such-source", "name": "odd"},
        {"type": "auth", "path": f"{folder}/auth", **own}])
    read = events.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.lit(None).cast("string").alias("failed"))
    return read.unionByName(failures.select("source", F.lit(0).cast("long").alias("events"), F.col("type").alias("failed")))


@register("file_sources", O.with_events(f"""
{_JSON_EVENTS.replace('v AS (', 'v2 AS (', 1).replace('FROM v JOIN', 'FROM v2 JOIN')},
f AS (SELECT source, hostname, base_severity AS severity, line_us AS ts_us FROM p
      UNION ALL SELECT source, hostname, severity, ts_us FROM je)
SELECT source, hostname, severity, 2 * count(*) AS events, 2 * count(*) AS ids, max(ts_us) AS newest FROM f GROUP BY ALL"""))
def file_sources(spark, sf):
    """The three readers over text files (every line twice): all lines arrive, and equal lines keep ids of their own."""
    folder = f"{ensure_checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = derived.log_lines(spark, sf)
    twice = F.explode(F.array_repeat("value", 2)).alias("value")
    for kind in ("syslog", "auth"):
        lines.where(F.col("source") == kind).select(twice).write.text(f"{folder}/{kind}")
    derived.json_lines(spark, sf).select(twice).write.text(f"{folder}/json")
    ev = fan_in(spark, [
        {"type": "syslog", "path": f"{folder}/syslog", "year": derived.LOG_YEAR, "now": derived.FALLBACK},
        {"type": "auth", "path": f"{folder}/auth", "year": derived.LOG_YEAR, "now": derived.FALLBACK},
        {"type": "json", "path": f"{folder}/json", "now": derived.FALLBACK}])
    read = [spark.read.text(f"{folder}/{kind}") for kind in ("syslog", "auth", "json")]
    groups = ["source", "hostname", "severity"]
    ids = spread_by_input(ev.select(*groups, "id", ts_us().alias("ts")), read, *groups, "id")  # each id is told in one task
    return ids.groupBy(*groups).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("ids"), F.max("ts").alias("newest"))


# ----------------------------------------------------------------- normaliser
@register("normalize_events", O.with_events("""
SELECT event_id, ip_list, src_ip, usr, process, severity, geo_text FROM n"""))
def normalize_events(spark, sf):
    ev = view_events(spark, sf)
    return ev.select(F.col("seq").alias("event_id"), *norm_cols())


_DOC_SQL = f"""WITH d0 AS (SELECT doc_id, text AS message, regexp_extract_all(text, {O.q(O.IPV4)}) AS ips FROM documents)
SELECT doc_id,
  CASE WHEN len(ips) > 0 THEN array_to_string(ips, ',') END AS ip_list,
  ips[1] AS src_ip,
  {O._rx('message', O.USER, 1)} AS usr,
  {O._rx('message', O.PROCESS, 1)} AS process,
  CASE WHEN {O._any('lower(message)', O.CRITICAL)} THEN 'critical'
       WHEN {O._any('lower(message)', O.HIGH)} THEN 'high'
       WHEN {O._any('lower(message)', O.MEDIUM)} THEN 'medium' ELSE 'low' END AS severity,
  {O.GEO_TEXT} AS geo_text
FROM d0"""


@register("normalize_documents", _DOC_SQL)
def normalize_documents(spark, sf):
    docs = derived.load(spark, sf, "documents").select("doc_id", "text")
    ev = docs.select("doc_id", F.col("text").alias("message"), F.lit("low").alias("severity"),
                     F.create_map().cast("map<string,string>").alias("parsed_fields"))
    return normalize(ev).select("doc_id", *norm_cols())


@register("normalize_json", f"""WITH {_JSON_EVENTS},
ji AS (SELECT *, regexp_extract_all(message, {O.q(O.IPV4)}) AS ips FROM je)
SELECT event_id, {O._rx('message', O.PROCESS, 1)} AS process, {O._rx('message', O.USER, 1)} AS usr, ips[1] AS src_ip,
  CASE WHEN {O._any('lower(message)', O.CRITICAL)} THEN 'critical'
       WHEN {O._any('lower(message)', O.HIGH)} THEN 'high'
       WHEN {O._any('lower(message)', O.MEDIUM)} THEN 'medium' ELSE severity END AS severity, {O.GEO_TEXT} AS geo_text FROM ji""")
def normalize_json(spark, sf):
    """Events whose fields all come from the message: the process default, the user, addresses of each range."""
    ev = normalize(_json_events(spark, sf))
    pf = F.col("parsed_fields")
    return ev.select("event_id", pf["process"].alias("process"), pf["user"].alias("usr"), pf["src_ip"].alias("src_ip"),
                     "severity", geo_text(F.col("geo")).alias("geo_text"))


# ------------------------------------------------------------------ detection
_RULE_QUERIES = {
    "rule_failed_ssh_login": "gs-001",
    "rule_ssh_login_unusual": "gs-003",
    "rule_sudo_command": "gs-004",
    "rule_new_user": "gs-005",
    "rule_service_change": "gs-006",
    "rule_firewall_change": "gs-007",
    "rule_outbound_transfer": "gs-008",
}


def _alerts(spark, sf, rules) -> DataFrame:
    """Alerts of the rules over the stored events (scans read only the columns that the rules look at)."""
    return detect(read_events(spark, stored_tables(spark, sf)[0]), rules, nested_event=False)


def _rule_query(rule_id):
    def run(spark, sf):
        al = _alerts(spark, sf, [builtin_rule(rule_id)])
        return al.select("event_id", "rule_id", "rule_name", "severity")
    return run


for _name, _rid in _RULE_QUERIES.items():
    _n, _sev, _pred = O.BUILTIN_SQL[_rid]
    register(_name, O.with_events(
        f"SELECT eid AS event_id, {O.q(_rid)} AS rule_id, {O.q(_n)} AS rule_name, {O.q(_sev)} AS severity "
        f"FROM n WHERE {_pred}"))(_rule_query(_rid))


@register("rule_ssh_brute_force", O.with_alerts("""
SELECT eid AS event_id, rule_id, rule_name, severity, match_count FROM al WHERE rule_id = 'gs-002'"""))
def rule_ssh_brute_force(spark, sf):
    al = _alerts(spark, sf, [builtin_rule("gs-002")])
    return al.select("event_id", "rule_id", "rule_name", "severity", "match_count")


@register("detect_builtin", O.with_alerts("""
SELECT eid AS event_id, rule_id, severity, ts_us, alert_id FROM al"""))
def detect_builtin(spark, sf):
    al = _alerts(spark, sf, builtin_rules())
    return al.select("event_id", "rule_id", "severity", ts_us().alias("ts_us"),
                     F.col("id").alias("alert_id"))


# Custom rules covering every modifier and condition form.
CONDITION_RULES = [
    {"title": "prefix and suffix", "id": "c-01", "level": "medium",
     "detection": {"selection": {"message|startswith": "accepted", "message|endswith": "SSH2"}}},
    {"title": "regex on a parsed field", "id": "c-02", "level": "high",
     "detection": {"selection": {"user|re": r"^u1\d$"}, "condition": "selection"}},
    {"title": "value list and top-level field", "id": "c-03",
     "detection": {"selection": {"hostname": ["web01", "WEB02"], "process": "sudo"}}},
    {"title": "all of", "id": "c-04",
     "detection": {"selection_a": {"message|contains": "user"}, "selection_b": {"src_ip|startswith": "203."},
                   "condition": "all of selection_*"}},
    {"title": "two of, text after the pattern ignored", "id": "c-05",
     "detection": {"selection_a": {"message": "Failed"}, "selection_b": {"message": "invalid"},
                   "selection_c": {"event_type|contains": "ssh"}, "filter": {"hostname": "web03"},
                   "condition": "2 of selection_* and not filter"}},
    {"title": "or with and, not of a missing name", "id": "c-06",
     "detection": {"selection": {"keywords|contains": "iptables"}, "sel2": {"message|contains": "compaction"},
                   "filter": {"hostname": "web05"},
                   "condition": "selection and not filter or sel2 not nosuch"}},
    {"title": "absent field never matches, its negation does", "id": "c-07",
     "detection": {"selection": {"target_user": "root"}, "other": {"no_such_field": "x"},
                   "condition": "selection and not other"}},
    {"title": "invalid regex is false", "id": "c-08",
     "detection": {"selection": {"message|re": "("}}},
    {"title": "zero of is always true on severity", "id": "c-09",
     "detection": {"selection": {"severity": "critical"}, "condition": "0 of nothing*"}},
    {"title": "text form of a time", "id": "c-10",
     "detection": {"selection": {"timestamp|startswith": "2024-01-01 01:"}}},
    {"title": "text form of a list", "id": "c-11",
     "detection": {"selection": {"ip_addresses|contains": '"10.0.0.'}}},
]

_COND_SQL = """
SELECT eid AS event_id, 'c-01' AS rule_id FROM n WHERE starts_with(lower(message), 'accepted') AND ends_with(lower(message), 'ssh2')
UNION ALL SELECT eid AS event_id, 'c-02' FROM n WHERE regexp_matches(usr, '(?i)^u1\\d$')
UNION ALL SELECT eid AS event_id, 'c-03' FROM n WHERE (contains(lower(hostname), 'web01') OR contains(lower(hostname), 'web02'))
                                         AND contains(lower(process), 'sudo')
UNION ALL SELECT eid AS event_id, 'c-04' FROM n WHERE contains(lower(message), 'user') AND starts_with(src_ip, '203.')
UNION ALL SELECT eid AS event_id, 'c-05' FROM n WHERE
   (CAST(contains(lower(message), 'failed') AS INT) + CAST(contains(lower(message), 'invalid') AS INT)
    + CAST(coalesce(contains(lower(event_type), 'ssh'), false) AS INT)) >= 2
UNION ALL SELECT eid AS event_id, 'c-06' FROM n WHERE (contains(lower(message), 'iptables') AND NOT contains(lower(hostname), 'web05'))
                                          OR contains(lower(message), 'compaction')
UNION ALL SELECT eid AS event_id, 'c-07' FROM n WHERE coalesce(contains(lower(target_user), 'root'), false)
UNION ALL SELECT eid AS event_id, 'c-09' FROM n
UNION ALL SELECT eid AS event_id, 'c-10' FROM n WHERE strftime(log_ts, '%Y-%m-%d %H') = '2024-01-01 01'
UNION ALL SELECT eid AS event_id, 'c-11' FROM n WHERE len(list_filter(ips, lambda x: starts_with(x, '10.0.0.'))) > 0"""


@register("detect_conditions", O.with_events(_COND_SQL))
def detect_conditions(spark, sf):
    rules = [load_rule(dict(r, detection=dict(r["detection"]))) for r in CONDITION_RULES]
    return _alerts(spark, sf, rules).select("event_id", "rule_id")


def _numbered_rule(i: int) -> dict:
    """One of many rules, of four forms: a text, an ending, two texts on a host, one of two blocks."""
    detection = [
        {"selection": {"message|contains": f"u{i} "}},
        {"selection": {"message|endswith": f".4.{i // 4}"}},
        {"selection": {"message": [f"port {i}", f"segments {i}"], "hostname": f"web{i % 10:02d}"}, "filter": {"message|contains": "invalid"},
         "condition": "selection and not filter"},
        {"selection_a": {"message|startswith": f"u{i // 4} :"}, "selection_b": {"message|contains": f"kept {i // 4} "}, "condition": "1 of selection_*"},
    ][i % 4]
    return {"title": f"rule {i}", "id": f"m-{i}", "detection": detection}


MANY_RULES = 200


@register("detect_many_rules", O.with_events(f"""
mr AS (SELECT i, CAST(i AS VARCHAR) AS t, CAST(i // 4 AS VARCHAR) AS f FROM range({MANY_RULES}) AS r(i))
SELECT eid AS event_id, concat('m-', t) AS rule_id FROM n JOIN mr ON CASE i % 4
  WHEN 0 THEN contains(lower(message), concat('u', t, ' '))
  WHEN 1 THEN ends_with(lower(message), concat('.4.', f))
  WHEN 2 THEN (contains(lower(message), concat('port ', t)) OR contains(lower(message), concat('segments ', t)))
       AND contains(lower(hostname), concat('web', lpad(CAST(i % 10 AS VARCHAR), 2, '0'))) AND NOT contains(lower(message), 'invalid')
  ELSE starts_with(lower(message), concat('u', f, ' :')) OR contains(lower(message), concat('kept ', f, ' ')) END"""))
def detect_many_rules(spark, sf):
    """Two hundred rules at once: candidates by one pattern a field, then the candidates' own predicates."""
    rules = [load_rule(_numbered_rule(i)) for i in range(MANY_RULES)]
    return _alerts(spark, sf, rules).select("event_id", "rule_id")


THRESHOLD_RULE = {
    "title": "Repeated logins per user", "id": "t-01", "level": "high",
    "detection": {
        "selection_failed": {"message|contains": "Failed password"},
        "selection_ok": {"message|startswith": "Accepted"},
        "filter_invalid": {"message|contains": "invalid user"},
        "threshold": {"field": "user", "value": 2},
        "timeframe": "10m",
        "condition": "this text is ignored for threshold rules",
    },
}


@register("threshold_per_user", O.with_events(f"""
tm AS (SELECT event_id, epoch_us(log_ts) AS ts_us, coalesce(usr, '__unknown__') AS gkey, eid FROM n
       WHERE ({O._c('Failed password')} OR starts_with(lower(message), 'accepted'))
         AND NOT {O._c('invalid user')}),
tc AS (SELECT eid, {O._count_sql('gkey', 600_000_000)} AS match_count FROM tm)
SELECT eid AS event_id, 't-01' AS rule_id, match_count FROM tc WHERE match_count >= 2"""))
def threshold_per_user(spark, sf):
    import copy
    al = _alerts(spark, sf, [load_rule(copy.deepcopy(THRESHOLD_RULE))])
    return al.select("event_id", "rule_id", "match_count")


@register("threshold_day", O.with_events(f"""
tm AS (SELECT event_id, eid, epoch_us(log_ts) AS ts_us, '__unknown__' AS gkey FROM n),
tc AS (SELECT eid, {O._count_sql('gkey', 86_400_000_000)} AS match_count FROM tm)
SELECT eid AS event_id, match_count FROM tc WHERE match_count >= 100"""))
def threshold_day(spark, sf):
    """A day-long window with all events on one key (a field that no event has)."""
    rule = load_rule({"title": "busy day", "id": "t-02", "detection": {
        "selection": {"severity": ["low", "medium", "high", "critical"]}, "threshold": {"field": "no_such_field", "value": 100}, "timeframe": "1d"}})
    return _alerts(spark, sf, [rule]).select("event_id", "match_count")


# ------------------------------------------------------------ stored tables
def _stored_events(spark, sf) -> DataFrame:
    return spark.read.schema(stored_schema(STORED_EVENT)).parquet(stored_tables(spark, sf)[0])


def _stored_alerts(spark, sf) -> DataFrame:
    return read_alerts(spark, stored_tables(spark, sf)[1])


def _nested_alerts(spark, sf) -> DataFrame:
    """Stored alerts with their events: what de-duplication and the sinks work on."""
    events = read_events(spark, stored_tables(spark, sf)[0])
    ev = events.select(F.struct(*EVENT_COLUMNS).alias("event"), F.col("event_date").alias("_date"))
    al = _stored_alerts(spark, sf)
    return al.join(ev, (F.col("event_id") == F.col("event.id")) & (F.col("event_date") == F.col("_date"))).drop("_date")


@register("batch_detect", O.with_alerts("SELECT alert_id AS id, rule_id, eid AS event_id, ts_us FROM al"))
def batch_detect(spark, sf):
    """P2: the alerts that ``detect_stored`` wrote."""
    return _stored_alerts(spark, sf).select("id", "rule_id", "event_id", ts_us().alias("ts_us"))


@register("detect_summary", O.with_alerts("SELECT (SELECT count(*) FROM al) AS alerts, (SELECT count(*) FROM n) AS events, 8 AS rules"))
def detect_summary(spark, sf):
    """P3: the counts that a run reports; run again over the same tables, it stores nothing new."""
    events, alerts = stored_tables(spark, sf)
    again = detect_stored(spark, events, alerts)
    n = _stored_alerts(spark, sf).count() if again["alerts"] == 0 else -1
    return spark.range(1).select(F.lit(n).alias("alerts"), F.lit(again["events"]).alias("events"), F.lit(again["rules"]).alias("rules"))


@register("dedup_alerts", O.with_kept("SELECT alert_id AS id, rule_id FROM kept WHERE kept"))
def dedup_alerts(spark, sf):
    return dispatched(_nested_alerts(spark, sf), 300).select("id", "rule_id")


@register("dedup_flags", O.with_kept("SELECT alert_id AS id, kept AS dispatched FROM kept"))
def dedup_flags(spark, sf):
    return dedup(_nested_alerts(spark, sf), 300).select("id", "dispatched")


@register("dedup_stats", O.with_kept("SELECT count_if(kept) AS total_dispatched, count_if(NOT kept) AS total_suppressed, 3 AS active_handlers FROM kept"))
def dedup_stats(spark, sf):
    return dispatch_stats(dedup(_nested_alerts(spark, sf), 300), handlers=3)


@register("dedup_off", O.with_alerts("""
SELECT alert_id AS id, true AS dispatched FROM al"""))
def dedup_off(spark, sf):
    return dedup(_nested_alerts(spark, sf), 0).select("id", "dispatched")


LIST_START = "2024-01-01 01:00:00"
LIST_END = "2024-01-01 03:30:00"


@register("events_listing", O.with_events(f"""
SELECT eid AS id, epoch_us(log_ts) AS ts_us, hostname, severity FROM n
WHERE severity = 'high' AND source = 'auth' AND log_ts >= TIMESTAMP '{LIST_START}' AND log_ts <= TIMESTAMP '{LIST_END}'
ORDER BY log_ts DESC, eid DESC LIMIT 100 OFFSET 20"""))
def events_listing(spark, sf):
    page = Q.query_events(_stored_events(spark, sf), severity="high", source="auth", hostname="", start_time=LIST_START,
                          end_time=LIST_END, limit=100, offset=20)
    return page.select("id", ts_us().alias("ts_us"), "hostname", "severity")


@register("events_deep_page", O.with_events("""
SELECT eid AS id, epoch_us(log_ts) AS ts_us, hostname, severity FROM n ORDER BY log_ts DESC, eid DESC LIMIT 100 OFFSET 3000"""))
def events_deep_page(spark, sf):
    """The page after three pages of 1000 events, each found from the end of the one before it."""
    table, dates = _stored_events(spark, sf), table_dates(spark, stored_tables(spark, sf)[0])
    cursor = None
    for _ in range(3):
        cursor = Q.page_cursor(Q.page_after(table, dates, cursor, limit=1000))
    return Q.page_after(table, dates, cursor).select("id", ts_us().alias("ts_us"), "hostname", "severity")


@register("events_of_host", O.with_events("""
SELECT eid AS id, hostname, message FROM n WHERE hostname = 'web03' ORDER BY log_ts DESC, eid DESC LIMIT 100"""))
def events_of_host(spark, sf):
    return Q.query_events(_stored_events(spark, sf), hostname="web03").select("id", "hostname", "message")


@register("alerts_listing", O.with_alerts(f"""
SELECT alert_id AS id, rule_id, ts_us, severity FROM al
WHERE severity = 'high' AND rule_id = 'gs-007' AND ts_us >= epoch_us(TIMESTAMP '{LIST_START}')
ORDER BY ts_us DESC, alert_id DESC LIMIT 50 OFFSET 10"""))
def alerts_listing(spark, sf):
    page = Q.query_alerts(_stored_alerts(spark, sf), severity="high", rule_id="gs-007", start_time=LIST_START, limit=50, offset=10)
    return page.select("id", "rule_id", ts_us().alias("ts_us"), "severity")


@register("page_envelope", O.with_events("""
pg AS (SELECT eid, row_number() OVER (ORDER BY log_ts DESC, eid DESC) AS place FROM n WHERE source = 'syslog')
SELECT count(*) AS count, 25 AS "limit", 5 AS "offset", string_agg(eid, ',' ORDER BY place) AS ids FROM pg WHERE place BETWEEN 6 AND 30"""))
def page_envelope(spark, sf):
    """The page's rows in order: newest first, as listed."""
    page = Q.query_events(_stored_events(spark, sf), source="syslog", limit=25, offset=5).select("timestamp", "id")
    env = Q.page_envelope(page, 25, 5)
    return env.select("count", "limit", "offset", F.array_join(F.col("events.id"), ",").alias("ids"))


@register("stats_totals", O.with_alerts("""
SELECT (SELECT count(*) FROM n) AS total_events, (SELECT count(*) FROM al) AS total_alerts"""))
def stats_totals(spark, sf):
    return Q.totals(_stored_events(spark, sf), _stored_alerts(spark, sf))


@register("events_by_severity", O.with_events("SELECT severity, count(*) AS count FROM n GROUP BY severity"))
def events_by_severity(spark, sf):
    return Q.by_severity(_stored_events(spark, sf))


@register("alerts_by_severity", O.with_alerts("SELECT severity, count(*) AS count FROM al GROUP BY severity"))
def alerts_by_severity(spark, sf):
    return Q.by_severity(_stored_alerts(spark, sf))


@register("top_rules", O.with_alerts("""
SELECT rule_name, count(*) AS count FROM al GROUP BY rule_name ORDER BY count DESC, rule_name LIMIT 10"""))
def top_rules(spark, sf):
    return Q.top_rules(_stored_alerts(spark, sf))


_NOW_SQL = "TIMESTAMP '2024-01-02 02:00:00'"


@register("events_per_hour", O.with_events(f"""
SELECT strftime(date_trunc('hour', log_ts), '%Y-%m-%d %H:00') AS hour, count(*) AS count FROM n
WHERE log_ts >= {_NOW_SQL} - INTERVAL 24 HOURS GROUP BY 1 ORDER BY 1"""))
def events_per_hour(spark, sf):
    return Q.events_per_hour(_stored_events(spark, sf), STATS_NOW)


@register("events_per_hour_boundary_day", O.with_events(f"""
SELECT strftime(date_trunc('hour', log_ts), '%Y-%m-%d %H:00') AS hour, count(*) AS count FROM n
WHERE log_ts >= CAST(CAST({_NOW_SQL} - INTERVAL 24 HOURS AS DATE) AS TIMESTAMP) GROUP BY 1 ORDER BY 1"""))
def events_per_hour_boundary_day(spark, sf):
    return Q.events_per_hour(_stored_events(spark, sf), STATS_NOW, whole_boundary_day=True)


_BUNDLE_SQL = f"""
SELECT 'total_events' AS metric, CAST(NULL AS VARCHAR) AS key, count(*) AS value FROM n
UNION ALL SELECT 'total_alerts', NULL, count(*) FROM al
UNION ALL SELECT 'events_by_severity', severity, count(*) FROM n GROUP BY severity
UNION ALL SELECT 'alerts_by_severity', severity, count(*) FROM al GROUP BY severity
UNION ALL SELECT * FROM (SELECT 'top_rules', rule_name, count(*) AS c FROM al GROUP BY rule_name ORDER BY c DESC, rule_name LIMIT 10)
UNION ALL SELECT 'events_per_hour', strftime(date_trunc('hour', log_ts), '%Y-%m-%d %H:00'), count(*) FROM n
          WHERE log_ts >= {_NOW_SQL} - INTERVAL 24 HOURS GROUP BY 2"""


@register("stats_bundle", O.with_alerts(_BUNDLE_SQL))
def stats_bundle(spark, sf):
    return Q.stats_bundle(_stored_events(spark, sf), _stored_alerts(spark, sf), STATS_NOW)


@register("status_summary", O.with_alerts("""
SELECT 'total_events' AS metric, CAST(NULL AS VARCHAR) AS key, count(*) AS value FROM n
UNION ALL SELECT 'total_alerts', NULL, count(*) FROM al
UNION ALL SELECT 'events_by_severity', severity, count(*) FROM n GROUP BY severity
UNION ALL SELECT * FROM (SELECT 'top_rules', rule_name, count(*) AS c FROM al GROUP BY rule_name ORDER BY c DESC, rule_name LIMIT 5)"""))
def status_summary(spark, sf):
    return Q.status_summary(_stored_events(spark, sf), _stored_alerts(spark, sf))


@register("alerts_with_event", O.with_alerts("""
SELECT alert_id, rule_id, eid AS event_id, hostname, message FROM al"""))
def alerts_with_event(spark, sf):
    events = _stored_events(spark, sf).select("id", "hostname", "message", "event_date")
    j = Q.alerts_with_events(_stored_alerts(spark, sf).select("id", "rule_id", "event_id", "event_date"), events)
    return j.select(F.col("id").alias("alert_id"), "rule_id", "event_id", F.col("ev_hostname").alias("hostname"), F.col("ev_message").alias("message"))


@register("sink_new_events", O.with_events("""
SELECT source, count(*) AS added, count(*) AS stored, count(DISTINCT eid) AS ids FROM n GROUP BY source
UNION ALL SELECT 'again', 0, count(*), count(DISTINCT eid) FROM n"""))
def sink_new_events(spark, sf):
    """A6: appends to a table. Syslog first, then everything twice (only auth is new), then everything again."""
    path = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    ev = read_events(spark, stored_tables(spark, sf)[0])
    added = {"syslog": append_events(spark, ev.where("source = 'syslog'"), path),
             "auth": append_events(spark, ev.unionByName(ev), path), "again": append_events(spark, ev, path)}
    stored = spark.read.schema(stored_schema(STORED_EVENT)).parquet(path)
    counts = [F.count(F.lit(1)).alias("stored"), F.count_distinct("id").alias("ids")]
    n = F.create_map(*[F.lit(x) for kv in added.items() for x in kv])
    return (stored.groupBy("source").agg(*counts).union(stored.agg(F.lit("again"), *counts))
            .select("source", n[F.col("source")].cast("long").alias("added"), "stored", "ids"))


@register("stored_roundtrip", O.with_events("""
SELECT eid AS id, usr, src_ip, ip_list, geo_text, severity, line AS raw FROM n"""))
def stored_roundtrip(spark, sf):
    back = read_events(spark, stored_tables(spark, sf)[0])
    return back.select("id", F.col("parsed_fields")["user"].alias("usr"),
                       F.col("parsed_fields")["src_ip"].alias("src_ip"),
                       F.when(F.size("ip_addresses") > 0, F.array_join("ip_addresses", ",")).alias("ip_list"),
                       geo_text(F.col("geo")).alias("geo_text"), "severity", "raw")


@register("event_json_roundtrip", O.with_events("""
SELECT eid AS id, epoch_us(log_ts) AS ts_us, source, hostname, severity, message, line AS raw, usr, src_ip, ip_list, geo_text FROM n"""))
def event_json_roundtrip(spark, sf):
    back = event_from_json(event_json(view_events(spark, sf)))
    return back.select("id", ts_us().alias("ts_us"), "source", "hostname", "severity", "message", "raw",
                       F.col("parsed_fields")["user"].alias("usr"), F.col("parsed_fields")["src_ip"].alias("src_ip"),
                       F.when(F.size("ip_addresses") > 0, F.array_join("ip_addresses", ",")).alias("ip_list"),
                       geo_text(F.col("geo")).alias("geo_text"))


# Fixed values (must equal the reference): descriptions of the built-in rules.
_DESCRIPTIONS = """(VALUES
  ('gs-001', 'Detects failed SSH login attempts indicating potential unauthorized access.'),
  ('gs-002', 'Detects 5+ failed SSH logins from same IP in 60s, indicating brute force.'),
  ('gs-003', 'Detects successful SSH logins which may originate from unusual or external sources.'),
  ('gs-004', 'Detects execution of commands via sudo, which may indicate privilege escalation.'),
  ('gs-005', 'Detects creation of new user accounts via useradd or adduser.'),
  ('gs-006', 'Detects system service state changes which may indicate tampering or maintenance.'),
  ('gs-007', 'Detects modifications to firewall rules via iptables or ufw.'),
  ('gs-008', 'Detects log entries indicating large outbound transfers, potential exfil.')) d(rid, description)"""
_ISO_SQL = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@register("alert_console", O.with_alerts(f"""
SELECT rule_name, upper(severity) AS severity, d.description, substr(message, 1, 200) AS event,
       source || ' @ ' || hostname AS source, {_ISO_SQL} AS time
FROM al JOIN {_DESCRIPTIONS} ON al.rule_id = d.rid"""))
def alert_console(spark, sf):
    return console_records(_nested_alerts(spark, sf))


_ALERT_JSON_SQL = f"""
SELECT al.alert_id AS id, al.rule_id, al.rule_name, al.severity, al.ts_us, d.description, al.eid AS event_id, al.hostname,
       n.severity AS event_severity, al.message, n.line AS raw, n.usr, n.src_ip, n.ip_list, n.geo_text
FROM al JOIN {_DESCRIPTIONS} ON al.rule_id = d.rid JOIN n ON n.eid = al.eid"""


def _decoded(alerts: DataFrame) -> DataFrame:
    pf = F.col("event.parsed_fields")
    return alerts.select(
        "id", "rule_id", "rule_name", "severity", ts_us().alias("ts_us"), "description", "event_id", F.col("event.hostname").alias("hostname"),
        F.col("event.severity").alias("event_severity"), F.col("event.message").alias("message"), F.col("event.raw").alias("raw"),
        pf["user"].alias("usr"), pf["src_ip"].alias("src_ip"),
        F.when(F.size("event.ip_addresses") > 0, F.array_join("event.ip_addresses", ",")).alias("ip_list"),
        geo_text(F.col("event.geo")).alias("geo_text"))


@register("alert_json_roundtrip", O.with_alerts(_ALERT_JSON_SQL))
def alert_json_roundtrip(spark, sf):
    return _decoded(alert_from_json(alert_json(_nested_alerts(spark, sf))))


@register("alert_file_lines", O.with_alerts(_ALERT_JSON_SQL))
def alert_file_lines(spark, sf):
    """A8: the lines of the alert file, read back."""
    path = f"{ensure_checkpoint_dir(spark)}/alerts-{uuid.uuid4().hex}"
    file_sink(path)(_nested_alerts(spark, sf), 0)
    return _decoded(alert_from_json(spark.read.text(path)))


@register("alert_outbox", O.with_alerts("""
SELECT alert_id AS id, 'https://hook.example/alerts' AS url, '{"Content-Type":"application/json"}' AS headers, 7 AS batch_id, eid AS event_id FROM al"""))
def alert_outbox(spark, sf):
    """A10 and A11: the delivery table, filled by a fan-out whose other sink fails."""
    path = f"{ensure_checkpoint_dir(spark)}/outbox-{uuid.uuid4().hex}"

    def broken(df, batch_id):
        raise OSError("down")

    fan_out(_nested_alerts(spark, sf), 7, [broken, outbox_sink(path, "https://hook.example/alerts")], persist=False)
    box = spark.read.parquet(path)
    sent = alert_from_json(box.select("payload", "url", "headers", "batch_id"), "payload")
    return (box.select("url", "headers", F.col("batch_id").cast("int").alias("batch_id"), F.get_json_object("payload", "$.id").alias("id"))
            .join(sent.select("id", "event_id"), "id"))


# ------------------------------------------------------------------ streaming
def _stored_stream(spark, sf):
    return stream_stored_events(spark, stored_tables(spark, sf)[0]).withWatermark("timestamp", "7 days")


@register("stream_dedup", O.with_kept("SELECT alert_id AS id, rule_id, kept AS dispatched FROM kept"))
def stream_dedup_query(spark, sf):
    """F1 + F4 + G2 on a stream: the stored events streamed through all eight rules and the dedup state, to the end."""
    out = stream_dedup(stream_alerts(_stored_stream(spark, sf), builtin_rules()), 300)
    return run_to_end(out.select("id", "rule_id", "dispatched"), "dedup")


@register("stream_brute_force", O.with_alerts("""
SELECT alert_id AS id, rule_id, match_count FROM al WHERE rule_id = 'gs-002'"""))
def stream_brute_force(spark, sf):
    """F4 alone: the brute-force threshold rule on the stream."""
    out = stream_alerts(_stored_stream(spark, sf), [builtin_rule("gs-002")])
    return run_to_end(out.select("id", "rule_id", "match_count"), "brute_force")


@register("stream_events_per_hour", O.with_events("""
SELECT strftime(date_trunc('hour', log_ts), '%Y-%m-%d %H:00') AS hour, count(*) AS count FROM n GROUP BY 1"""))
def stream_events_per_hour_query(spark, sf):
    """H10 on a stream: the hours of each micro-batch are upserted; closed hours leave the state."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/hours-{uuid.uuid4().hex}"
    out = stream_events_per_hour(stream_stored_events(spark, stored_tables(spark, sf)[0]), "7 days")
    upsert_hours(out, f"{base}/out", f"{base}/ck", availableNow=True).awaitTermination()
    return read_hours(spark, f"{base}/out")


@register("live_pipeline", O.with_alerts("""
SELECT rule_id, count(*) AS alerts, count(*) AS with_event, count(DISTINCT alert_id) AS ids FROM al GROUP BY rule_id"""))
def live_pipeline(spark, sf):
    """A4 and P1: files of the view's lines are followed, stored, detected on and their alerts stored; each alert joins its event."""
    base = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    derived.log_lines(spark, sf).select("source", "value").write.partitionBy("source").text(f"{base}/in")  # the lines are built once
    sources = [live_source(spark, f"{base}/in/source={kind}", kind, year=derived.LOG_YEAR, now=derived.FALLBACK) for kind in ("syslog", "auth")]
    to_end(start_live(spark, sources, f"{base}/events", f"{base}/alerts", f"{base}/state", watermark="7 days", trigger_seconds=0))
    j = Q.alerts_with_events(read_alerts(spark, f"{base}/alerts"), spark.read.schema(stored_schema(STORED_EVENT)).parquet(f"{base}/events"))
    return j.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"), F.count("ev_id").alias("with_event"), F.count_distinct("id").alias("ids"))


def _append_lines(lines: DataFrame, folder: str) -> None:
    """Log writers: each task appends its lines, in order, to the files of its own writers."""
    def write(rows) -> None:
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        for writer, own in groupby(rows, key=lambda r: r["writer"]):
            with files.open_append_stream(f"{base}/{writer}.log") as f:
                for r in own:
                    f.write(r["value"].encode() + b"\n")

    dealt = lines.select("value", "event_id", F.pmod("event_id", F.lit(4)).alias("writer"))
    dealt.repartition("writer").sortWithinPartitions("writer", "event_id").foreachPartition(write)


@register("live_appended", O.with_kept("""
SELECT al.rule_id, count(*) AS alerts, count(*) AS with_event, count(DISTINCT al.alert_id) AS ids, count(*) FILTER (kept.kept) AS sent
FROM al JOIN kept ON kept.alert_id = al.alert_id GROUP BY al.rule_id"""))
def live_appended(spark, sf):
    """A4, P1, A11: growing files are followed by byte offsets; between two appends every query stops and starts again from
    its checkpoint. Alerts are stored, and the dispatched ones reach the sink."""
    base = f"{ensure_checkpoint_dir(spark)}/appended-{uuid.uuid4().hex}"
    lines = derived.log_view(spark, sf).withColumn("value", F.col("dirty"))
    middle = lines.agg(F.percentile_approx("log_ts", 0.5)).first()[0]
    for part in (F.col("log_ts") < middle, F.col("log_ts") >= middle):
        for kind in ("syslog", "auth"):
            _append_lines(lines.where(part & (F.col("source") == kind)), f"{base}/in/{kind}")
        sources = [appended_source(spark, f"{base}/in/{kind}", kind, start="beginning", year=derived.LOG_YEAR, now=derived.FALLBACK)
                   for kind in ("syslog", "auth")]
        to_end(start_events(spark, sources, f"{base}/events", f"{base}/state", trigger_seconds=0))
        sent = [lambda df, batch_id: df.select("id", "rule_id").write.mode("append").parquet(f"{base}/sent")]
        to_end(start_alerts(spark, f"{base}/events", f"{base}/alerts", f"{base}/state", sent, watermark="7 days", trigger_seconds=0))
    j = Q.alerts_with_events(read_alerts(spark, f"{base}/alerts"), spark.read.schema(stored_schema(STORED_EVENT)).parquet(f"{base}/events"))
    out = spark.read.schema("id string, rule_id string").parquet(f"{base}/sent").groupBy("rule_id").agg(F.count(F.lit(1)).alias("sent"))
    return (j.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"), F.count("ev_id").alias("with_event"), F.count_distinct("id").alias("ids"))
            .join(out, "rule_id", "left"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Parse -> normalise -> store -> all built-in rules -> dedup: the alerts that go out."""
    return dispatched(_nested_alerts(spark, sf), 300).select(
        "id", "rule_id", "rule_name", "severity", ts_us().alias("ts_us"),
        F.col("event.hostname").alias("hostname"), F.col("event.message").alias("message"))
