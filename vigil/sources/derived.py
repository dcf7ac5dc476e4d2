"""Log lines derived from the driver's ``events`` table.

The test tables hold no log text, so the driver queries build syslog / auth / NDJSON lines from ``events``
with SQL that Spark and DuckDB both run. The text lines use a clock of 2 s per event id (so that 60 s
thresholds can fire) and one address for 25 consecutive events (bursts); the JSON lines carry the table's own
``ts``, ``value`` and ``props``. The templates are chosen so that every branch of the parsers and of the
normaliser occurs: unreadable times, lines with blanks around them, messages that two patterns match, severity
words, competing, null and missing JSON keys. Work grows with the ``events`` table; nothing is made up.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
# Year written into the year-less syslog time of the derived lines, and the time that stands in for an unreadable one.
LOG_YEAR = 2024
FALLBACK = _dt.datetime(2024, 1, 1, 3, 21, 7, tzinfo=_dt.timezone.utc)
FALLBACK_SQL = "TIMESTAMP '2024-01-01 03:21:07'"

_BODY = """
WITH b AS (
  SELECT event_id, ts, value, user_id, event_type, event_id % 97 = 5 AS no_time, {CLOCK} AS clock,
         CAST(floor(event_id / 25.0) AS BIGINT) AS burst, coalesce(regexp_extract(props, '([0-9]+)', 1), '') AS k, props
  FROM {EVENTS}),
c AS (
  SELECT *, CASE WHEN no_time THEN {FALLBACK} ELSE clock END AS log_ts,
         concat('web', lpad(CAST(user_id % 10 AS {STR}), 2, '0')) AS host, concat('u', CAST(user_id AS {STR})) AS usr,
         CASE burst % 4 WHEN 0 THEN concat('10.0.0.', CAST(burst % 8 AS {STR}))
                        WHEN 1 THEN concat('172.20.0.', CAST(burst % 8 AS {STR}))
                        ELSE concat('203.0.113.', CAST(burst % 16 AS {STR})) END AS ip,
         CAST(1024 + event_id % 60000 AS {STR}) AS port
  FROM b),
d AS (
  SELECT *,
    CASE WHEN event_type IN ('error','click') THEN 'sshd' WHEN event_type = 'purchase' THEN 'sudo'
         WHEN event_type = 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'useradd' ELSE 'userdel' END
         ELSE CASE event_id % 5 WHEN 0 THEN 'systemd' WHEN 4 THEN 'storaged' ELSE 'root' END END AS proc,
    CASE event_type
      WHEN 'error' THEN concat('Failed password for ', CASE event_id % 3 WHEN 0 THEN 'invalid user ' ELSE '' END, usr, ' from ', ip, ' port ', port, ' ssh2')
      WHEN 'click' THEN concat('Accepted ', CASE event_id % 2 WHEN 0 THEN 'publickey' ELSE 'password' END, ' for ', usr, ' from ', ip, ' port ', port, ' ssh2')
      WHEN 'purchase' THEN CASE event_id % 4
         WHEN 0 THEN concat(usr, ' : TTY=pts/3 ; PWD=/srv/', usr, ' ; USER=postgres ; COMMAND=/usr/bin/pg_ctl reload')
         WHEN 2 THEN concat(usr, ' : TTY=pts/8 ; PWD=/srv ; USER=root ; COMMAND=/bin/echo Accepted password for ops from ', ip, ' port 22')
         ELSE 'pam_unix(cron:session): COMMAND=/usr/local/bin/sweep' END
      WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN concat('new user: name=', usr, ', UID=20', k, ', home=/srv/', usr)
                                           ELSE concat('delete user ', chr(39), usr, chr(39)) END
      ELSE CASE event_id % 10
         WHEN 0 THEN 'Started chronyd.service - NTP client/server'
         WHEN 1 THEN concat('iptables -I FORWARD -s 198.18.', k, '.0/24 -j REJECT')
         WHEN 2 THEN 'ufw STATUS: inactive'
         WHEN 3 THEN concat('scp /srv/export/', usr, '.tgz to ', ip)
         WHEN 4 THEN concat('compaction kept ', k, ' segments')
         WHEN 5 THEN concat('read error on volume ', k)
         WHEN 6 THEN concat('upstream timeout via 192.168.4.', k)
         WHEN 7 THEN concat('worker[', k, ']: segfault in pool of 172.16.0.9')
         WHEN 8 THEN concat('permission denied, user=', usr)
         ELSE concat('Stopped backup.timer: invalid ticket from 127.0.0.1 and 127.0.0.1') END END AS message
  FROM c),
e AS (
  SELECT *, concat(CASE WHEN no_time THEN 'Xyz 01 00:00:00' ELSE {FMT} END, ' ', host, ' ', proc,
                   CASE event_id % 7 WHEN 0 THEN '' ELSE concat('[', CAST(event_id AS {STR}), ']') END, ': ', message) AS line
  FROM d)
SELECT event_id, log_ts, CASE event_type WHEN 'view' THEN 'syslog' ELSE 'auth' END AS source, host AS hostname, proc AS process, message, line,
       CASE event_id % 11 WHEN 3 THEN concat(chr(9), ' ', line, '  ', chr(9)) ELSE line END AS dirty, ts, value, props
FROM e
"""

# One JSON object a line. The time key and form go by event_id % 8, the host by % 3, the message by % 5, the level by % 9,
# a mapped source by % 7.
_JSON = """
SELECT event_id, concat('{{',
  CASE event_id % 8
    WHEN 0 THEN concat('"timestamp": "', {ISO}, 'Z", ')
    WHEN 1 THEN concat('"time": ', CAST({EPOCH} AS {STR}), ', ')
    WHEN 2 THEN concat('"@timestamp": "', {PLAIN}, '", ')
    WHEN 3 THEN concat('"time": "', {ISO2}, '+02:00", ')
    WHEN 4 THEN concat('"timestamp": null, "time": "', {ISO}, 'Z", ')
    WHEN 5 THEN '"time": "some day", '
    WHEN 6 THEN ''
    ELSE concat('"time": "', CAST({EPOCH} AS {STR}), '", ') END,
  CASE event_id % 3 WHEN 0 THEN concat('"host": "', hostname, '", ') WHEN 1 THEN concat('"hostname": "other", "host": "', hostname, '", ') ELSE '' END,
  CASE event_id % 5 WHEN 4 THEN '' ELSE concat('"msg": "', message, '", ') END,
  CASE event_id % 9 WHEN 8 THEN '' WHEN 7 THEN '"level": null, ' ELSE concat('"level": "', {LEVEL}, '", ') END,
  CASE event_id % 7 WHEN 3 THEN '"source": "mapped", ' ELSE '' END,
  '"props": ', coalesce(props, 'null'), ', "pid": ', CAST(event_id AS {STR}), '}}') AS line
FROM ({VIEW})
"""
LEVEL = """CASE WHEN message LIKE 'Failed%' THEN 'ERROR' WHEN message LIKE 'Accepted%' THEN 'High'
     WHEN message LIKE '%COMMAND=%' THEN 'medium' WHEN process = 'useradd' THEN 'Critical' ELSE 'info' END"""

SPARK_PARTS = {
    "CLOCK": "timestamp_seconds(1704067200 + event_id * 2)", "STR": "STRING", "FALLBACK": FALLBACK_SQL,
    "FMT": "date_format(log_ts, 'MMM dd HH:mm:ss')", "EVENTS": "{events}", "LEVEL": LEVEL,
    "ISO": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "PLAIN": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "ISO2": "date_format(ts + INTERVAL 2 HOURS, \"yyyy-MM-dd'T'HH:mm:ss\")", "EPOCH": "unix_seconds(CAST(ts AS TIMESTAMP))",
}
DUCK_PARTS = {
    "CLOCK": "make_timestamp((1704067200 + event_id * 2) * 1000000)", "STR": "VARCHAR", "FALLBACK": FALLBACK_SQL,
    "FMT": "strftime(log_ts, '%b %d %H:%M:%S')", "EVENTS": "events", "LEVEL": LEVEL,
    "ISO": "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "PLAIN": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "ISO2": "strftime(ts + INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%S')", "EPOCH": "CAST(floor(epoch(ts)) AS BIGINT)",
}


def _fill(body: str, parts: dict) -> str:
    for k, v in parts.items():
        body = body.replace("{" + k + "}", v)
    return body


def spark_view_sql() -> str:
    """Spark text of the derived view; ``{events}`` is a DataFrame argument."""
    return _fill(_BODY, SPARK_PARTS)


def duck_log_view_sql() -> str:
    """DuckDB text of the derived view (reads the pre-registered ``events``)."""
    return _fill(_BODY, DUCK_PARTS)


def duck_json_sql() -> str:
    return _fill(_JSON, DUCK_PARTS | {"VIEW": duck_log_view_sql()}).replace("{{", "{").replace("}}", "}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table dealt evenly: its rows are a few bytes each and the lines built from them many times that, so the
    splits of its file are too few and too uneven for the work that follows."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return load(spark, sf_dir, "events").select(*COLUMNS).repartition(n, "event_id")


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, log_ts, source, hostname, process, message, line, dirty, ts, value, props)."""
    return spark.sql(spark_view_sql(), events=_events(spark, sf_dir))


def log_lines(spark: SparkSession, sf_dir: str, source: str | None = None) -> DataFrame:
    """The derived view's text lines, as files would hold them: (event_id, source, value)."""
    v = log_view(spark, sf_dir)
    if source is not None:
        v = v.filter(v.source == source)
    return v.select("event_id", "source", v.dirty.alias("value"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value) NDJSON lines; the messages hold no double quote or backslash, so they need no escapes."""
    sql = _fill(_JSON, SPARK_PARTS | {"VIEW": spark_view_sql()})
    return spark.sql(sql, events=_events(spark, sf_dir)).withColumnRenamed("line", "value")
