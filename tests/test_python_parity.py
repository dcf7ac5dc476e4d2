"""Java regex (with the Python-compatible flags) versus Python ``re`` on the
real multilingual texts of the test tables (whole tables, whole texts)."""
import re

import pandas as pd
from pyspark.sql import functions as F

from vigil.functions.text import group_at, regex_split
from vigil.operators import normalize as N
from vigil.operators.normalize import normalize
from vigil.sources import lines as L

SF = "/root/testdata/sf0.01"


def py_normalize(text):
    ips = re.findall(N.IPV4, text)
    m = re.search(N.USER_IN_TEXT, text, re.IGNORECASE)
    p = re.match(N.PROCESS_PREFIX, text)
    low = text.lower()
    sev = "low"
    for level, words in (("critical", N.CRITICAL_WORDS), ("high", N.HIGH_WORDS), ("medium", N.MEDIUM_WORDS)):
        if any(w in low for w in words):
            sev = level
            break
    return (",".join(ips) or None, m.group(1) if m else None, p.group(1) if p else None, sev)


def test_normaliser_matches_python_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ev = docs.select("doc_id", F.col("text").alias("message"), F.lit("low").alias("severity"),
                     F.create_map().cast("map<string,string>").alias("parsed_fields"))
    got = {r["doc_id"]: (",".join(r["ip_addresses"]) if r["ip_addresses"] else None,
                         r["parsed_fields"].get("user"), r["parsed_fields"].get("process"), r["severity"])
           for r in normalize(ev).collect()}
    want = {r.doc_id: py_normalize(r.text) for r in docs.toPandas().itertuples()}
    assert got == want


def test_line_patterns_match_python_on_conversation_lines(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet").select("text").toPandas()
    lines = [ln for t in conv.text for ln in t.split("\n") if ln]
    # add log-shaped variants so the patterns also hit
    lines += [f"Jan  5 01:02:03 h{i} p[{i}]: Failed password for {w} from 1.2.3.{i} port {i} ssh2"
              for i, w in enumerate(lines[:200])]
    df = spark.createDataFrame(pd.DataFrame({"value": lines}))
    pats = [("hdr", L.HEADER, 5, True)] + [(p, pat, n, False) for p, pat, n in L.AUTH_GROUPS]
    arr = df.select("value", *[regex_split(F.col("value"), pat, n, anchored=a).alias(k) for k, pat, n, a in pats])
    out = arr.select("value", *[group_at(F.col(k), i + 1).alias(f"{k}{i}") for k, _, n, _ in pats for i in range(n)])
    got = {r["value"]: r for r in out.collect()}
    for line in lines:
        r = got[line]
        for k, pat, n, anchored in pats:
            m = re.match(pat, line) if anchored else re.search(pat, line)
            want = [(m.group(i + 1) or None) if m else None for i in range(n)]
            assert [r[f"{k}{i}"] for i in range(n)] == want, (k, line)
