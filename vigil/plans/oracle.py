"""DuckDB SQL that computes each registered query independently.

Used by the driver's correctness gate: the Spark result and this SQL are run
on the same Parquet tables and compared. The SQL re-derives everything from
the ``events`` / ``documents`` views with DuckDB's own regex engine, window
functions and a recursive CTE; patterns and word lists are written out here, not taken from the operators. Only the
text of the derived log lines (the input) is shared.
"""

from __future__ import annotations

from vigil.sources import derived

# Fixed values (must equal the reference): line patterns, word lists, address prefixes.
HEADER = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
FAILED = r"Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)"
ACCEPTED = r"Accepted (?:password|publickey) for (\S+) from (\S+) port (\d+)"
SUDO = r"(\S+)\s*:\s*TTY=\S+\s*;\s*PWD=(\S+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)"
ADDED = r"new user: name=(\S+),.*"
DELETED = r"delete user '(\S+)'"
LINE_HIGH = ("error", "fail", "denied", "critical", "panic")
LINE_MEDIUM = ("warn", "timeout", "refused", "invalid")
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER = r"(?i)(?:user[= ]|for (?:invalid user )?)(\S+)"
PROCESS = r"^(\S+?)(?:\[\d+\])?:"
CRITICAL = ("kernel panic", "out of memory", "segfault", "buffer overflow", "root compromise")
HIGH = ("failed password", "authentication failure", "permission denied", "unauthorized", "invalid user", "break-in attempt")
MEDIUM = ("sudo", "session opened", "session closed", "connection refused", "timeout")


def q(pattern: str) -> str:
    """SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def _rx(col: str, pattern: str, group: int, flags: str = "") -> str:
    return f"NULLIF(regexp_extract({col}, {q(flags + pattern)}, {group}), '')"


GEO_TEXT = """CASE WHEN len(ips) > 0 THEN array_to_string(list_sort(list_distinct(list_transform(ips, lambda x:
      x || '=' || CASE WHEN starts_with(x, '10.') OR starts_with(x, '172.16.') OR starts_with(x, '192.168.')
                            OR starts_with(x, '127.') THEN 'internal/N/A' ELSE 'external/unknown' END))), ',') END"""


def events_cte() -> str:
    """CTEs ``v`` (view), ``p`` (parsed), ``n`` (normalised events)."""
    H = HEADER
    auth_sev = ("CASE WHEN del_user IS NOT NULL OR add_user IS NOT NULL THEN 'high' "
                "WHEN s_user IS NOT NULL OR a_user IS NOT NULL THEN 'medium' "
                "WHEN f_user IS NOT NULL THEN 'high' ELSE 'low' END")
    sys_sev = (f"CASE WHEN {_any('lower(message)', LINE_HIGH)} THEN 'high' "
               f"WHEN {_any('lower(message)', LINE_MEDIUM)} THEN 'medium' ELSE 'low' END")
    return f"""
v AS ({derived.duck_log_view_sql()}),
h AS (
  SELECT event_id, log_ts, source, hostname, line, ts, value, props,
    regexp_extract(line, {q(H)}, 1) AS ts_text,
    regexp_extract(line, {q(H)}, 3) AS process,
    {_rx('line', H, 4)} AS pid,
    regexp_extract(line, {q(H)}, 5) AS message
  FROM (SELECT * REPLACE (regexp_replace(dirty, '^\\s+|\\s+$', '', 'g') AS line) FROM v)),
a AS (
  SELECT h.*,
    {_rx('message', FAILED, 1)} AS f_user, {_rx('message', FAILED, 2)} AS f_ip,
    {_rx('message', FAILED, 3)} AS f_port,
    {_rx('message', ACCEPTED, 1)} AS a_user, {_rx('message', ACCEPTED, 2)} AS a_ip,
    {_rx('message', ACCEPTED, 3)} AS a_port,
    {_rx('message', SUDO, 1)} AS s_user, {_rx('message', SUDO, 2)} AS s_pwd,
    {_rx('message', SUDO, 3)} AS s_target, {_rx('message', SUDO, 4)} AS s_cmd,
    {_rx('message', ADDED, 1)} AS add_user, {_rx('message', DELETED, 1)} AS del_user
  FROM h),
p AS (
  SELECT event_id, log_ts, source, hostname, line, ts_text, process, pid, message,
    CASE WHEN source = 'auth' THEN
      CASE WHEN del_user IS NOT NULL THEN 'user_deleted' WHEN add_user IS NOT NULL THEN 'user_created'
           WHEN s_user IS NOT NULL THEN 'sudo' WHEN a_user IS NOT NULL THEN 'ssh_accepted'
           WHEN f_user IS NOT NULL THEN 'ssh_failed' END END AS event_type,
    CASE WHEN source = 'auth' THEN coalesce(del_user, add_user, s_user, a_user, f_user) END AS p_user,
    CASE WHEN source = 'auth' THEN coalesce(a_ip, f_ip) END AS p_src_ip,
    CASE WHEN source = 'auth' THEN coalesce(a_port, f_port) END AS port,
    CASE WHEN source = 'auth' THEN s_target END AS target_user,
    CASE WHEN source = 'auth' THEN s_cmd END AS command,
    CASE WHEN source = 'auth' THEN s_pwd END AS pwd,
    CASE WHEN source = 'auth' THEN {auth_sev} ELSE {sys_sev} END AS base_severity,
    coalesce(epoch_us(try_strptime('2024 ' || regexp_replace(ts_text, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')), epoch_us({derived.FALLBACK_SQL})) AS line_us,
    sha256(concat_ws(chr(1), source, 'events', line, CAST(event_id AS VARCHAR))) AS eid
  FROM a),
n0 AS (
  SELECT p.*, regexp_extract_all(message, {q(IPV4)}) AS ips FROM p),
n AS (
  SELECT n0.*,
    coalesce(p_src_ip, ips[1]) AS src_ip,
    coalesce(p_user, {_rx('message', USER, 1)}) AS usr,
    CASE WHEN {_any('lower(message)', CRITICAL)} THEN 'critical'
         WHEN {_any('lower(message)', HIGH)} THEN 'high'
         WHEN {_any('lower(message)', MEDIUM)} THEN 'medium'
         ELSE base_severity END AS severity,
    CASE WHEN len(ips) > 0 THEN array_to_string(ips, ',') END AS ip_list,
    {GEO_TEXT} AS geo_text
  FROM n0)"""


def with_events(select: str) -> str:
    return "WITH " + events_cte() + ",\n" + select


# Built-in rule predicates over the normalised events (message substring,
# case-insensitive), and their severities.
def _c(word: str) -> str:
    return f"contains(lower(message), {q(word.lower())})"


BUILTIN_SQL = {
    "gs-001": ("Failed SSH Login", "high", _c("Failed password")),
    "gs-003": ("SSH Login From Unusual Source", "medium", _c("Accepted")),
    "gs-004": ("Sudo Command Executed", "medium", f"{_c('COMMAND=')} AND NOT {_c('pam_unix')}"),
    "gs-005": ("New User Account Created", "high", f"({_c('useradd')} OR {_c('adduser')} OR {_c('new user')})"),
    "gs-006": ("Service Started or Stopped", "low", f"({_c('Started')} OR {_c('Stopped')} OR {_c('systemctl')})"),
    "gs-007": ("Firewall Rule Change Detected", "high", f"({_c('iptables')} OR {_c('ufw')})"),
    "gs-008": ("Large Outbound Data Transfer Indicator", "high",
               f"({_c('scp')} OR {_c('rsync')} OR {_c('curl')} OR {_c('wget')})"),
}
BRUTE = ("gs-002", "SSH Brute Force Attempt", "critical")


def _count_sql(key: str, window_us: int, part: str = "") -> str:
    p = f"{part}, " if part else ""
    return (f"count(*) OVER (PARTITION BY {p}{key} ORDER BY ts_us RANGE BETWEEN {window_us} PRECEDING AND CURRENT ROW)"
            f" - count(*) OVER (PARTITION BY {p}{key}, ts_us)"
            f" + row_number() OVER (PARTITION BY {p}{key}, ts_us ORDER BY eid)")


def alerts_cte() -> str:
    """``al``: alerts of the built-in rules (event_id, rule_id, rule_name,
    severity, ts_us, source, hostname, message, eid, alert_id, match_count)."""
    parts = [f"""SELECT event_id, {q(rid)} AS rule_id, {q(name)} AS rule_name, {q(sev)} AS severity,
        epoch_us(log_ts) AS ts_us, source, hostname, message, eid, CAST(NULL AS BIGINT) AS match_count FROM n WHERE {pred}"""
             for rid, (name, sev, pred) in BUILTIN_SQL.items()]
    parts.append(f"""SELECT event_id, {q(BRUTE[0])}, {q(BRUTE[1])}, {q(BRUTE[2])}, ts_us, source, hostname,
        message, eid, match_count FROM bf WHERE match_count >= 5""")
    brute = f"""bm AS (SELECT n.*, epoch_us(log_ts) AS ts_us, coalesce(src_ip, '__unknown__') AS gkey FROM n
            WHERE {_c('Failed password')}),
bf AS (SELECT bm.*, {_count_sql('gkey', 60_000_000)} AS match_count FROM bm)"""
    return (brute + ",\nal0 AS (" + "\nUNION ALL\n".join(parts) + """),
al AS (SELECT al0.*, sha256(concat_ws(chr(1), rule_id, rule_name, eid)) AS alert_id FROM al0)""")


def with_alerts(select: str) -> str:
    return "WITH " + events_cte() + ",\n" + alerts_cte() + ",\n" + select


def with_kept(select: str) -> str:
    return "WITH RECURSIVE " + events_cte() + ",\n" + alerts_cte() + ",\n" + dedup_cte() + select


def dedup_cte(window_us: int = 300_000_000) -> str:
    """``kept``: alerts after greedy dedup,
    computed with a recursive CTE that walks each key in order."""
    return f"""
dk AS (SELECT event_id, rule_id, ts_us, alert_id,
         row_number() OVER (PARTITION BY rule_id, source, hostname ORDER BY ts_us, alert_id) AS rn,
         rule_id || chr(1) || source || chr(1) || hostname AS k
       FROM al),
walk AS (
  SELECT k, rn, ts_us AS last, true AS kept, event_id, rule_id, alert_id FROM dk WHERE rn = 1
  UNION ALL
  SELECT d.k, d.rn,
         CASE WHEN d.ts_us - w.last > {window_us} THEN d.ts_us ELSE w.last END,
         d.ts_us - w.last > {window_us}, d.event_id, d.rule_id, d.alert_id
  FROM walk w JOIN dk d ON d.k = w.k AND d.rn = w.rn + 1),
kept AS (SELECT event_id, rule_id, alert_id, kept FROM walk)"""
