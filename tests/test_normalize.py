from conftest import events_df
from vigil.operators.normalize import normalize


def run(spark, rows):
    return {r["message"]: r for r in normalize(events_df(spark, rows)).collect()}


def test_ip_user_process_geo(spark):
    msgs = [
        {"message": "sshd[77]: Connection from 10.1.2.3 to 172.20.0.5 and 10.1.2.3 and 999.1.1.1"},
        {"message": "pam_unix(sshd:session): session opened for user root by (uid=0)"},
        {"message": "plain text", "parsed_fields": {"src_ip": "1.1.1.1", "user": "keep", "process": "p"}},
        {"message": "user=alice logged in from 192.168.0.9", "severity": "high"},
    ]
    r = run(spark, msgs)
    a = r[msgs[0]["message"]]
    assert a["ip_addresses"] == ["10.1.2.3", "172.20.0.5", "10.1.2.3", "999.1.1.1"]  # in order, duplicates kept
    assert a["parsed_fields"]["src_ip"] == "10.1.2.3"
    assert a["parsed_fields"]["process"] == "sshd"
    geo = a["geo"]
    assert geo["10.1.2.3"]["type"] == "internal" and geo["10.1.2.3"]["country"] == "N/A"
    assert geo["172.20.0.5"]["type"] == "external"  # only the 172.16. prefix counts
    assert len(geo) == 3
    b = r[msgs[1]["message"]]
    assert b["parsed_fields"]["user"] == "user"  # "for " matches before "user "
    assert b["severity"] == "medium"
    c = r["plain text"]
    assert c["parsed_fields"] == {"src_ip": "1.1.1.1", "user": "keep", "process": "p"}
    assert c["ip_addresses"] is None and c["geo"] is None
    d = r[msgs[3]["message"]]
    assert d["parsed_fields"]["user"] == "alice"
    assert d["severity"] == "high"  # no keyword: kept


def test_severity_can_be_lowered(spark):
    r = run(spark, [{"message": "error: connection timeout", "severity": "high"},
                    {"message": "kernel panic - not syncing", "severity": "low"},
                    {"message": "Failed password for x", "severity": "low"}])
    assert r["error: connection timeout"]["severity"] == "medium"
    assert r["kernel panic - not syncing"]["severity"] == "critical"
    assert r["Failed password for x"]["severity"] == "high"
