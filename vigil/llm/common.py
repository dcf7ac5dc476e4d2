"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import apply_defaults, ensure_checkpoint_dir


def prepare(spark: SparkSession) -> None:
    """Session settings of this subpackage: code for the Python workers, the shared
    checkpoint folder, and Arrow batches bounded in rows and bytes (texts may be long)."""
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder, a file or a folder of part files."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex64(c: Column) -> Column:
    """A long as 16 lowercase hex digits (two's complement)."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def literal(value, schema: str) -> Column:
    """A constant of any nested type, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{schema}>")["v"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shielded(df: DataFrame, used: list[str], fn) -> DataFrame:
    """``fn(df)`` with every column outside ``used`` out of the way of its working names, then the columns of ``df`` again."""
    names = df.columns
    inner = [c if c in used else f"__extra{i}" for i, c in enumerate(names)]
    out = fn(df.toDF(*inner))
    return out.select(*inner).toDF(*names)
