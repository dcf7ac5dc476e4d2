import datetime as dt

import pytest

from conftest import UTC, events_df
from vigil.operators.builtin import builtin_rules
from vigil.operators.detect import detect
from vigil.operators.normalize import normalize
from vigil.operators.rules import load_rule, load_rules_dir, parse_timeframe

SAMPLES = [
    ("Failed password for invalid user mreyes from 198.51.100.7 port 40022 ssh2", "auth", {"gs-001"}),
    ("Accepted password for lkohl from 10.77.3.9 port 61002 ssh2", "auth", {"gs-003"}),
    ("lkohl : TTY=pts/4 ; PWD=/srv/jobs ; USER=postgres ; COMMAND=/usr/bin/pg_ctl reload", "auth", {"gs-004"}),
    ("pam_unix(cron:session): COMMAND=/usr/local/bin/sweep", "auth", set()),
    ("new user: name=svc_batch, UID=2077, GID=2077, home=/srv/batch", "auth", {"gs-005"}),
    ("adduser finished; new user: name=kiosk3, UID=2078", "auth", {"gs-005"}),
    ("cron: nightly vacuum done", "syslog", set()),
    ("iptables -D FORWARD -s 198.18.0.0/15 -j DROP", "syslog", {"gs-007"}),
    ("Stopped chronyd.service - NTP client/server", "syslog", {"gs-006"}),
    ("ufw STATUS: inactive", "syslog", {"gs-007"}),  # the filter after "1 of" is ignored
    ("rsync -a /srv/export/ backup.example:/in", "syslog", {"gs-008"}),
]


def fired(spark, rows, rules):
    al = detect(events_df(spark, rows), rules).collect()
    out = {}
    for a in al:
        out.setdefault(a["event"]["message"], set()).add(a["rule_id"])
    return out


def test_builtin_rules(spark):
    rows = [{"message": m, "source": s, "timestamp": dt.datetime(2024, 1, 1, 0, i, tzinfo=UTC)}
            for i, (m, s, _) in enumerate(SAMPLES)]
    got = fired(spark, rows, builtin_rules())
    for m, _, want in SAMPLES:
        assert got.get(m, set()) == want, m
    assert len(builtin_rules()) == 8


def test_alert_fields(spark):
    rows = [{"message": SAMPLES[0][0]}]
    a = detect(events_df(spark, rows), builtin_rules()).collect()[0]
    assert (a["rule_id"], a["rule_name"], a["severity"]) == ("gs-001", "Failed SSH Login", "high")
    assert a["timestamp"] == a["event"]["timestamp"] and a["event_id"] == "e0000"
    assert len(a["id"]) == 64


def rule(det, **kw):
    return load_rule({"title": kw.get("title", "t"), "id": kw.get("id", "r"), "detection": det,
                      "level": kw.get("level", "low")})


CASES = [
    ({"selection": {"message|endswith": "SSH2"}}, "Failed password for x from 1.2.3.4 port 1 ssh2", True),
    ({"selection": {"message|startswith": "failed"}}, "Failed password", True),
    ({"selection": {"message|re": r"port \d+ ssh"}}, "x port 22 SSH2", True),
    ({"selection": {"message|re": "("}}, "(", False),  # invalid regex: no match, no failure
    ({"selection": {"message": ["nope", "PASS"]}}, "password", True),
    ({"selection": {"message": []}}, "x", False),
    ({"selection": {"message|contains|all": ["a", "zz"]}}, "abc", True),  # only the first modifier counts
    ({"selection": {"no_field": "x"}}, "x", False),
    ({"selection": {"message": "x"}, "other": {"no_field": "x"}, "condition": "selection and not other"}, "x", True),
    ({"selection": {"message": "x"}, "condition": "selection and not nosuch"}, "x", True),
    ({"selection": {"message": "x"}, "condition": "not not selection"}, "x", True),  # 2nd "not" = unknown name
    ({"selection": {"message": "a"}, "s2": {"message": "b"}, "condition": "selection s2"}, "ab", True),
    ({"selection": {"message": "a"}, "s2": {"message": "b"}, "condition": "selection AND s2"}, "a", False),
    ({"selection": {"message": "a"}, "s2": {"message": "b"}, "condition": "selection or s2"}, "b", True),
    ({"selection_a": {"message": "a"}, "selection_b": {"message": "b"}, "condition": "all of selection_*"}, "ab", True),
    ({"selection_a": {"message": "a"}, "selection_b": {"message": "b"}, "condition": "all of selection_*"}, "a", False),
    ({"selection": {"message": "a"}, "condition": "all of nothing*"}, "a", False),
    ({"selection": {"message": "q"}, "condition": "0 of selection*"}, "a", True),
    ({"selection": {"message": "a"}, "condition": "1 of them"}, "a", False),
    ({"selection_a": {"message": "a"}, "selection_b": {"message": "b"}, "condition": "2 of selection_*"}, "a", False),
    ({"selection_a": {"message": "a"}, "selection_b": {"message": "b"}, "condition": "2 of selection_*"}, "ba", True),
    ({"selection": {"message": "x"}, "condition": ""}, "x", False),
    ({"selection": {"hostname": "GATE"}}, "x", True),
    ({"selection": {"severity": "low"}}, "x", True),
    ({"selection": {"keywords": "X"}}, "x", True),
    ({"selection": {"timestamp|startswith": "2024-04-15 10:00:00+00"}}, "x", True),
    ({"selection": {"user": "bob"}}, "session for bob", True),
]


@pytest.mark.parametrize("det,message,expect", CASES)
def test_conditions(spark, det, message, expect):
    ev = normalize(events_df(spark, [{"message": message}]))
    al = detect(ev, [rule(det)]).count()
    assert (al == 1) is expect


def threshold_rule(value=3, tf="60s", field="src_ip", filt=None):
    det = {"selection": {"message|contains": "Failed password"}, "threshold": {"field": field, "value": value},
           "timeframe": tf}
    if filt:
        det["filter"] = filt
    return rule(det, id="bf")


def test_threshold_per_ip(spark):
    t0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [{"message": f"Failed password for root from {ip} port 1", "timestamp": t0 + dt.timedelta(seconds=i),
             "parsed_fields": {"src_ip": ip}, "id": f"e{i}"}
            for i, ip in enumerate(["1.2.3.4", "1.2.3.4", "1.2.3.4", "5.6.7.8"])]
    al = detect(events_df(spark, rows), [threshold_rule(3)]).collect()
    assert [a["event_id"] for a in al] == ["e2"]
    assert al[0]["match_count"] == 3


def test_threshold_window_edges_and_no_reset(spark):
    t0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
    secs = [0, 60, 61, 200, 200, 200]
    rows = [{"message": "Failed password", "timestamp": t0 + dt.timedelta(seconds=s), "id": f"e{i}"}
            for i, s in enumerate(secs)]
    al = {a["event_id"]: a["match_count"] for a in detect(events_df(spark, rows), [threshold_rule(2)]).collect()}
    # 0 and 60 are both inside [60-60, 60]; 61 sees 60 and 61; equal times count one by one
    assert al == {"e1": 2, "e2": 2, "e4": 2, "e5": 3}


def test_threshold_group_field_filter_and_unknown(spark):
    t0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [{"message": "Failed password", "timestamp": t0 + dt.timedelta(seconds=i), "id": f"e{i}"} for i in range(3)]
    rows.append({"message": "Failed password invalid", "timestamp": t0 + dt.timedelta(seconds=3), "id": "e3"})
    al = detect(events_df(spark, rows), [threshold_rule(3, "5m", "user", {"message|contains": "invalid"})]).collect()
    assert [(a["event_id"]) for a in al] == ["e2"]  # key __unknown__, filtered row not counted


def test_bad_threshold_rules_never_fire(spark):
    rows = [{"message": "Failed password"}]
    bad = rule({"selection": {"message": "Failed"}, "threshold": 5, "timeframe": "60s"})
    bad2 = rule({"selection": {"message": "Failed"}, "threshold": {"value": 1}, "timeframe": 60})
    ok = rule({"selection": {"message": "Failed"}, "threshold": {"value": 1}, "timeframe": "1m"})
    assert detect(events_df(spark, rows), [bad, bad2]).count() == 0
    assert detect(events_df(spark, rows), [ok]).count() == 1


def test_timeframe_and_loader(tmp_dir):
    assert parse_timeframe("60s") == 60 and parse_timeframe("5m") == 300
    assert parse_timeframe("1.5h") == 5400 and parse_timeframe("2d") == 172800 and parse_timeframe("45") == 45
    with open(f"{tmp_dir}/b.yml", "w") as fh:
        fh.write("title: B\ndetection:\n  selection:\n    message: x\nlevel: High\n")
    with open(f"{tmp_dir}/a.yaml", "w") as fh:
        fh.write("title: A\ndetection:\n  nothing: {}\n")  # no selection: skipped
    with open(f"{tmp_dir}/c.yml", "w") as fh:
        fh.write("- not a mapping\n")
    rules = load_rules_dir(tmp_dir)
    assert [r.title for r in rules] == ["B"]
    assert rules[0].severity == "high" and rules[0].condition == "selection" and rules[0].id == ""


def test_thresholds_with_different_windows_in_one_pass(spark):
    t0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rnd = __import__("random").Random(3)
    rows = [{"message": "Failed password", "timestamp": t0 + dt.timedelta(seconds=rnd.randint(0, 900)),
             "id": f"e{i}", "parsed_fields": {"src_ip": rnd.choice(["1.1.1.1", "2.2.2.2"])}} for i in range(300)]
    ev = events_df(spark, rows)
    r1 = threshold_rule(4, "30s")
    r2 = rule({"selection": {"message|contains": "failed"}, "threshold": {"value": 9}, "timeframe": "2m"}, id="bf2")
    both = {(a["rule_id"], a["event_id"], a["match_count"]) for a in detect(ev, [r1, r2]).collect()}
    alone = {(a["rule_id"], a["event_id"], a["match_count"]) for a in
             detect(ev, [r1]).collect() + detect(ev, [r2]).collect()}
    assert both == alone and len({x[0] for x in both}) == 2


def test_detection_plan_shape(spark):
    import re as _re
    ev = events_df(spark, [{"message": "Failed password"}])

    def hash_exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return len(_re.findall(r"(?m)^[\s:+|-]*Exchange hashpartitioning", plan))

    plain = [r for r in __import__("vigil.operators.builtin", fromlist=["x"]).builtin_rules() if r.id != "gs-002"]
    assert hash_exchanges(detect(ev, plain)) == 0  # plain rules: one narrow pass
    r2 = rule({"selection": {"message|contains": "failed"}, "threshold": {"value": 9}, "timeframe": "2m"}, id="bf2")
    both = detect(ev, plain + [threshold_rule(4, "30s"), r2])
    assert hash_exchanges(both) == hash_exchanges(detect(ev, [threshold_rule(4, "30s")])) > 0  # all windows share them
    counts = both._jdf.queryExecution().executedPlan().toString()
    for line in counts.splitlines():  # the counting exchanges carry no event columns, and plain hits meet none
        if "Exchange hashpartitioning(rule_ord" in line:
            assert "message" not in line
