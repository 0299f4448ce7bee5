"""Structured streaming: ingest of turns as files arrive, daily histograms, and merging of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from memloom.operators.ingest import upsert_latest
from memloom.scratch import exists


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Rows of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Redelivered rows dropped as long as they come within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def day_histogram(stream: DataFrame, at: str, by: str, late: str = "1 day") -> DataFrame:
    """(day, by, n): rows per day; a day is final once the watermark has passed its end."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "1 day").alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), by, "n")


def merge_into(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch replaces the rows of its keys in a parquet table; the table is a new version after each batch.

    Of a batch's rows of one key the largest by the other columns, in their order, stays, so a batch that is run again
    gives the same version.  Every version but the first is built on the one before: if that is not there, or can't be
    read, the batch fails and nothing is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in keys]
        best = batch.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_best")) if others else batch.select(*keys).distinct()
        latest = best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}") for c in batch.columns])
        before = f"{target}/v{number - 1}"
        if number and not exists(spark, before):
            raise FileNotFoundError(f"version {number} of {target} needs {before}, which is not there")
        merged = upsert_latest(spark.read.parquet(before), latest, keys) if number else latest
        merged.write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
