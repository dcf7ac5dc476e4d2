"""Event enrichment: IPs, user, process, severity re-rating, internal/external.

One narrow projection over the event columns; it keeps the partitioning of
its input and adds no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.partitioning import generated
from vigil.schema import EVENT_NOT_NULL
from vigil.functions.text import contains_any, map_present, py_regex

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): patterns, keyword lists in the
# order they are tested, and the address prefixes counted as internal.
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER_IN_TEXT = r"(?:user[= ]|for (?:invalid user )?)(\S+)"
PROCESS_PREFIX = r"^(\S+?)(?:\[\d+\])?:"
CRITICAL_WORDS = ("kernel panic", "out of memory", "segfault", "buffer overflow", "root compromise")
HIGH_WORDS = ("failed password", "authentication failure", "permission denied", "unauthorized",
              "invalid user", "break-in attempt")
MEDIUM_WORDS = ("sudo", "session opened", "session closed", "connection refused", "timeout")
INTERNAL_PREFIXES = ("10.", "172.16.", "192.168.", "127.")
# ---------------------------------------------------------------------------


def extract_ips(message: Column) -> Column:
    """All IPv4-looking strings in order, duplicates kept (octets unchecked)."""
    return F.regexp_extract_all(message, F.lit(py_regex(IPV4)), 0)


def is_internal(ip: Column) -> Column:
    return reduce(lambda a, b: a | b, [ip.startswith(p) for p in INTERNAL_PREFIXES])


def reclassify(severity: Column, message: Column) -> Column:
    low = F.lower(message)
    return (F.when(contains_any(low, CRITICAL_WORDS), "critical")
            .when(contains_any(low, HIGH_WORDS), "high")
            .when(contains_any(low, MEDIUM_WORDS), "medium")
            .otherwise(severity))


def geo_map(ips: Column) -> Column:
    """Distinct IPs -> {type, country}; NULL when there are none."""
    entries = F.transform(
        F.array_distinct(ips),
        lambda ip: F.struct(
            ip.alias("key"),
            F.struct(
                F.when(is_internal(ip), "internal").otherwise("external").alias("type"),
                F.when(is_internal(ip), "N/A").otherwise("unknown").alias("country"),
            ).alias("value"),
        ),
    )
    return F.when(F.size(ips) > 0, F.map_from_entries(entries))


def normalize(df: DataFrame) -> DataFrame:
    """Apply the enrichment steps in the reference's order to EVENT rows.

    ``parsed_fields`` only gains keys it lacks; ``ip_addresses`` and ``geo``
    are typed columns. A JSON event that already carries ``ip_addresses``
    keeps that list.
    """
    pf, msg = F.col("parsed_fields"), F.col("message")
    # The regex results, computed once and turned into an explode output, so a
    # later filter on the enriched fields cannot re-run the regexes.
    found = F.struct(
        extract_ips(msg).alias("ips"),
        F.when(~map_present(pf, "user"), F.regexp_extract(msg, py_regex(USER_IN_TEXT, True), 1)).alias("user"),
        F.when(~map_present(pf, "process"), F.regexp_extract(msg, py_regex(PROCESS_PREFIX), 1)).alias("process"),
    )
    d = generated(df.select("*", found.alias("_nz_all")), "_nz_all", None, "_nz")
    d = d.withColumn("_ips", F.col("_nz.ips"))
    has = F.size(F.col("_ips")) > 0
    given_ips = F.when(map_present(pf, "ip_addresses"),
                       F.from_json(pf["ip_addresses"], "array<string>"))
    ips = F.when(map_present(pf, "ip_addresses"), given_ips).when(has, F.col("_ips"))
    add = F.map_filter(
        F.create_map(
            F.lit("src_ip"), F.when(has & ~map_present(pf, "src_ip"), F.get(F.col("_ips"), 0)),
            F.lit("user"), F.nullif(F.col("_nz.user"), F.lit("")),  # here, as nullif in the branch above would run the regex twice
            F.lit("process"), F.nullif(F.col("_nz.process"), F.lit("")),
        ),
        lambda k, v: v.isNotNull(),
    )
    d = d.withColumn("ip_addresses", ips)
    d = (d.withColumn("parsed_fields", F.map_concat(F.coalesce(pf, F.create_map().cast("map<string,string>")), add))
         .withColumn("severity", reclassify(F.col("severity"), msg))
         .withColumn("geo", geo_map(F.col("ip_addresses"))))
    return d.drop("_ips", "_nz")


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that can be stored, quarantined events that lack a required value).

    The reference's processing loop stops on a JSON event whose message is
    not text; here values are text already, and an event with a NULL in a required column (a JSON
    ``"msg": null``) is routed to a quarantine output instead."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in EVENT_NOT_NULL if c in events.columns])
    return events.filter(ok), events.filter(~ok)
