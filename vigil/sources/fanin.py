"""Several log sources as one event DataFrame (UNION ALL by column name).

A source config is a dict with ``type`` (syslog / auth / json) and the
reader's arguments. An entry without a type, with an unknown type or whose
reader fails to build is skipped with a warning; the others still run.

``fan_in`` is lazy: a source that fails while it is read fails the job that reads it. ``fan_in_staged`` reads every source
in a job of its own into the shared folder, so one that fails at run time leaves the others' rows and a row that says why.
"""

from __future__ import annotations

import logging
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from vigil.session import ensure_checkpoint_dir
from vigil.sources.lines import parse_auth, parse_syslog, read_auth, read_syslog
from vigil.sources.ndjson import parse_ndjson, read_ndjson

log = logging.getLogger(__name__)

READERS = {"syslog": read_syslog, "auth": read_auth, "json": read_ndjson}
PARSERS = {"syslog": parse_syslog, "auth": parse_auth, "json": parse_ndjson}
DEFAULT_NAMES = {"syslog": "syslog", "auth": "auth", "json": "json"}


def source_frame(spark: SparkSession, cfg: dict) -> DataFrame:
    """One source: ``path`` -> read files; ``lines`` (a DataFrame with a
    ``value`` column) -> parse those lines."""
    cfg = dict(cfg)
    kind = cfg.pop("type")
    name = cfg.pop("name", DEFAULT_NAMES[kind])
    for unused in ("poll_interval",):
        cfg.pop(unused, None)
    if "lines" in cfg:
        lines = cfg.pop("lines")
        return PARSERS[kind](lines, "value", name, **cfg)
    return READERS[kind](spark, cfg.pop("path"), name, **cfg)


def fan_in(spark: SparkSession, configs: list[dict]) -> DataFrame | None:
    frames = []
    for cfg in configs:
        kind = cfg.get("type")
        if kind is None:
            log.warning("source config without 'type' skipped: %s", cfg)
            continue
        if kind not in READERS:
            log.warning("unknown source type %r skipped", kind)
            continue
        try:
            frames.append(source_frame(spark, cfg))
        except Exception:  # noqa: BLE001 - one bad source must not stop the rest
            log.exception("source %r could not be built; skipped", cfg.get("name", kind))
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


FAILURE = "source string, type string, path string, error string"


def fan_in_staged(spark: SparkSession, configs: list[dict], folder: str | None = None, at_once: int = 4) -> tuple[DataFrame | None, DataFrame]:
    """(events of the sources that could be read, one row for each that could not).

    Every source is written to its own table under ``folder`` (default: a new one in the shared folder), ``at_once`` of them at
    a time; a source counts only when its whole table is committed. The caller removes the folder when done."""
    folder = folder or f"{ensure_checkpoint_dir(spark)}/fanin-{uuid.uuid4().hex}"

    def stage(item: tuple[int, dict]) -> tuple[DataFrame | None, tuple | None]:
        n, cfg = item
        kind = cfg.get("type")
        try:
            if kind not in READERS:
                raise ValueError("no source type" if kind is None else f"unknown source type {kind!r}")
            path = f"{folder}/{n}"
            frame = source_frame(spark, cfg)
            frame.write.mode("overwrite").parquet(path)
            return spark.read.schema(frame.schema).parquet(path), None
        except Exception as e:  # noqa: BLE001 - one bad source must not stop the rest
            log.exception("source %r failed", cfg.get("name", kind))
            first = (str(e).strip().splitlines() or [""])[0]
            return None, (cfg.get("name", kind), kind, str(cfg["path"]) if "path" in cfg else None, f"{type(e).__name__}: {first}"[:500])

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(stage), enumerate(configs)))
    frames = [frame for frame, _ in done if frame is not None]
    failures = spark.createDataFrame([f for _, f in done if f is not None], FAILURE)
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), failures
