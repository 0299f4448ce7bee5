"""Loading of the base tables and small helpers that hold for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.scratch import Scratch
from memloom.shipping import ship


def load(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table of ``folder`` as a DataFrame; with ``columns`` only these, so the scan reads no others."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def delivered_once(df: DataFrame, key: str) -> DataFrame:
    """Redelivered rows carry the same id: one row per id stays; a null id is no id and is dropped."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key])


#: Up to so many repeated keys (8 bytes each) are sent to every task; beyond, all rows are shuffled.
SENT_KEYS = 1_000_000


def once_by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per value of an integer key, like ``dropDuplicates``, but only repeated rows are shuffled.

    The keys alone are counted first; rows whose key stands once pass where they are.  Null keys are dropped.
    """
    own = df.filter(F.col(key).isNotNull())
    scratch = Scratch(df.sparkSession, "repeated")
    repeated = scratch.write(own.groupBy(key).count().filter("count > 1").select(key), "keys")
    n = repeated.count()
    if not n:
        return own
    if n > SENT_KEYS:
        return own.dropDuplicates([key])
    sent = F.broadcast(repeated)
    return own.join(sent, key, "left_anti").unionByName(own.join(sent, key, "left_semi").dropDuplicates([key])).select(*df.columns)
