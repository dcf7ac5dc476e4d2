"""Syslog and auth-log text lines -> EVENT rows (batch or stream).

The parse is one narrow projection of built-in expressions (each pattern is
evaluated once per row, see ``regex_split``), no Python per row, so it runs
inside whole-stage code generation and never shuffles.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.partitioning import generated, keep_rows
from vigil.functions.text import compact_map, contains_any, group_at, regex_split, ustrip
from vigil.functions.timeparse import syslog_time

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results): line patterns
# and keyword lists, in the reference's order.
HEADER = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
FAILED_SSH = r"Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)"
ACCEPTED_SSH = r"Accepted (?:password|publickey) for (\S+) from (\S+) port (\d+)"
SUDO = r"(\S+)\s*:\s*TTY=\S+\s*;\s*PWD=(\S+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)"
USER_ADD = r"new user: name=(\S+),.*"
USER_DEL = r"delete user '(\S+)'"
SYSLOG_HIGH_WORDS = ("error", "fail", "denied", "critical", "panic")
SYSLOG_MEDIUM_WORDS = ("warn", "timeout", "refused", "invalid")
# ---------------------------------------------------------------------------

ID_SEP = "\u0001"


def clean_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Strip Unicode whitespace at both ends, drop lines left empty."""
    return keep_rows(df.withColumn(col, ustrip(F.col(col))), F.col(col) != "")


def _header(df: DataFrame, line: str, year, now) -> DataFrame:
    v = F.col(line)
    # One evaluation of the header regex for all five groups (lines are
    # split on newlines, so none is inside a line).
    out = df.select("*", regex_split(v, HEADER, 5, anchored=True).alias("_hdr_all"))
    # Unmatched lines (one-element split) vanish; the groups are read from the
    # explode's output, so no later filter can re-run the regex.
    out = generated(out, "_hdr_all", F.size("_hdr_all") > 1, "_hdr")
    h = F.col("_hdr")
    out = out.select(*df.columns, *[F.nullif(F.get(h, i + 1), F.lit("")).alias(n) for i, n in
                                    enumerate(["_ts_text", "hostname", "_process", "_pid", "message"])])
    return out.withColumn("timestamp", syslog_time(F.col("_ts_text"), year, now)).withColumn("raw", v)


def syslog_severity(message: Column) -> Column:
    low = F.lower(message)
    return (F.when(contains_any(low, SYSLOG_HIGH_WORDS), "high")
            .when(contains_any(low, SYSLOG_MEDIUM_WORDS), "medium")
            .otherwise("low"))


def parse_syslog(df: DataFrame, line: str = "value", source: str | Column = "syslog",
                 year: int | None = None, now: _dt.datetime | None = None) -> DataFrame:
    """Syslog lines -> events; lines not in syslog form are dropped.

    Other columns of ``df`` are kept (e.g. a line ordinal for the id).
    """
    src = source if isinstance(source, Column) else F.lit(source)
    out = _header(df, line, year, now)
    return (out.withColumn("source", src)
            .withColumn("severity", syslog_severity(F.col("message")))
            .withColumn("parsed_fields", compact_map(("process", F.col("_process")), ("pid", F.col("_pid"))))
            .drop("_ts_text", "_process", "_pid"))


AUTH_GROUPS = [  # (column prefix, pattern, number of groups)
    ("f", FAILED_SSH, 3), ("a", ACCEPTED_SSH, 3), ("s", SUDO, 4), ("add", USER_ADD, 1), ("del", USER_DEL, 1)]
# A text that every match of the pattern holds. Lines without it are not searched: a pattern is tried at each place of a line, and
# the sudo one reads on to the end of a word from each.
AUTH_TEXTS = {"f": "Failed password for ", "a": "Accepted ", "s": "TTY=", "add": "new user: name=", "del": "delete user '"}


def with_auth_matches(df: DataFrame, message: Column, only=None) -> DataFrame:
    """Each auth pattern evaluated at most once per row (only where ``only`` holds and its text occurs),
    as a struct ``_m`` of match arrays that is an explode output, so later
    filters on auth fields cannot re-run the regexes."""
    arrays = [F.when(message.contains(AUTH_TEXTS[prefix]), regex_split(message, pattern, n)) for prefix, pattern, n in AUTH_GROUPS]
    if only is not None:
        arrays = [F.when(only, a) for a in arrays]
    m = F.struct(*[a.alias(prefix) for a, (prefix, _, _) in zip(arrays, AUTH_GROUPS)])
    return generated(df.select("*", m.alias("_m_all")), "_m_all", None, "_m")


def auth_group_columns() -> list[Column]:
    """Groups of the ``_m`` match arrays as ``_g_<prefix><i>``."""
    return [group_at(F.col("_m")[prefix], i + 1).alias(f"_g_{prefix}{i + 1}")
            for prefix, _, n in AUTH_GROUPS for i in range(n)]


def auth_fields(g=lambda name: F.col("_g_" + name)) -> dict[str, Column]:
    """SSH / sudo / user-management fields from the group columns.

    All five patterns are tried; a later match overwrites event type,
    severity and user, fields only an earlier pattern sets are kept.
    """
    f_user, f_ip, f_port = g("f1"), g("f2"), g("f3")
    a_user, a_ip, a_port = g("a1"), g("a2"), g("a3")
    s_user, s_pwd, s_target, s_cmd = g("s1"), g("s2"), g("s3"), g("s4")
    add_user = g("add1")
    del_user = g("del1")
    hits = [  # latest first: the first non-NULL wins in coalesce
        (del_user, "user_deleted", "high"),
        (add_user, "user_created", "high"),
        (s_user, "sudo", "medium"),
        (a_user, "ssh_accepted", "medium"),
        (f_user, "ssh_failed", "high"),
    ]
    event_type = F.coalesce(*[F.when(u.isNotNull(), F.lit(t)) for u, t, _ in hits])
    severity = F.coalesce(*[F.when(u.isNotNull(), F.lit(s)) for u, _, s in hits], F.lit("low"))
    return {
        "event_type": event_type,
        "user": F.coalesce(*[u for u, _, _ in hits]),
        "src_ip": F.coalesce(a_ip, f_ip),
        "port": F.coalesce(a_port, f_port),
        "target_user": s_target,
        "command": s_cmd,
        "pwd": s_pwd,
        "severity": severity,
    }


def parse_auth(df: DataFrame, line: str = "value", source: str | Column = "auth",
               year: int | None = None, now: _dt.datetime | None = None) -> DataFrame:
    """Auth-log lines -> events with SSH / sudo / user fields."""
    src = source if isinstance(source, Column) else F.lit(source)
    d = df.withColumn("_kind", F.lit("auth"))
    return parse_mixed(d, "_kind", line, year, now, source=src)


def parse_mixed(df: DataFrame, kind: str, line: str = "value", year: int | None = None,
                now: _dt.datetime | None = None, source: Column | None = None) -> DataFrame:
    """Lines of several kinds in one pass: column ``kind`` holds "auth" or
    "syslog" per line (and becomes ``source`` unless one is given). The
    header is parsed once;
    the auth patterns only run on auth lines (conditional branch). Same
    result as ``parse_auth`` / ``parse_syslog`` on the two subsets, without
    splitting the input into two scans and a union."""
    is_auth = F.col(kind) == "auth"
    out = _header(df, line, year, now)
    cols = out.columns
    out = with_auth_matches(out, F.col("message"), only=is_auth)
    out = out.select(*cols, *auth_group_columns())
    fields = auth_fields()
    out = out.select("*", *[c.alias("_a_" + k) for k, c in fields.items()])
    auth_pf = compact_map(
        ("process", F.col("_process")), ("pid", F.col("_pid")),
        ("event_type", F.col("_a_event_type")), ("user", F.col("_a_user")),
        ("src_ip", F.col("_a_src_ip")), ("port", F.col("_a_port")),
        ("target_user", F.col("_a_target_user")), ("command", F.col("_a_command")),
        ("pwd", F.col("_a_pwd")),
    )
    sys_pf = compact_map(("process", F.col("_process")), ("pid", F.col("_pid")))
    out = (out.withColumn("source", F.col(kind) if source is None else source)
           .withColumn("severity", F.when(is_auth, F.col("_a_severity")).otherwise(syslog_severity(F.col("message"))))
           .withColumn("parsed_fields", F.when(is_auth, auth_pf).otherwise(sys_pf)))
    groups = [f"_g_{p}{i + 1}" for p, _, n in AUTH_GROUPS for i in range(n)]
    drop = ["_ts_text", "_process", "_pid", *["_a_" + k for k in fields], *groups]
    return out.drop(*drop, *([kind] if kind != "source" else []))


def event_id(collector: Column, file_path: Column, raw: Column, occurrence: Column) -> Column:
    """Deterministic event id, the same in batch and live: the collector's name, the file, the line's text and which
    of the file's equal lines it is. (A source named inside the line has no part in it.)"""
    return F.sha2(F.concat_ws(ID_SEP, collector, file_path, raw, occurrence.cast("string")), 256)


def read_text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files -> (value, file_path), cleaned lines only."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file_path"))
    return clean_lines(df)


def numbered_lines(lines: DataFrame, collector: str) -> DataFrame:
    """(value, id) of every line: equal lines of a file are numbered 1..n.

    Equal lines cannot be told apart, so counting them and unfolding the count gives every numbering there is. The
    count is combined before the one exchange, which sends a line that repeats a billion times once a task."""
    counted = lines.groupBy("file_path", "value").agg(F.count(F.lit(1)).alias("_n"))
    each = counted.select("file_path", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_occurrence"))
    return each.select("value", event_id(F.lit(collector), F.col("file_path"), F.col("value"), F.col("_occurrence")).alias("id"))


def read_syslog(spark: SparkSession, path, name: str = "syslog", year=None, now=None) -> DataFrame:
    """Batch syslog source: whole files -> events with ids."""
    return parse_syslog(numbered_lines(read_text_lines(spark, path), name), "value", name, year, now).drop("value")


def read_auth(spark: SparkSession, path, name: str = "auth", year=None, now=None) -> DataFrame:
    """Batch auth-log source: whole files -> events with ids."""
    return parse_auth(numbered_lines(read_text_lines(spark, path), name), "value", name, year, now).drop("value")
