"""Streaming forms of the log and ledger operators (an extension: the batch forms are in operators.review)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_key_stream(events: DataFrame, key: str, at: str, *, delay: str = "1 day") -> DataFrame:
    """Events whose key did not come within the delay before; state is bounded by the watermark, later repetitions are left to ``apply_once``."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def balances_stream(entries: DataFrame, account: str, delta: str) -> DataFrame:
    """(account, entries, balance) in update mode; nulls count as 0."""
    return entries.groupBy(account).agg(F.count("*").alias("entries"), F.coalesce(F.sum(delta), F.lit(0)).alias("balance"))


def apply_once(path: str, key: str):
    """A foreachBatch function that appends the rows of each batch whose key is not in the table yet, however late they come.

    Of equal keys in a batch one row (the least as a struct) is kept; null keys are
    never applied.  A batch that is run again after a failure appends nothing twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(key).isNotNull())
        rows = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*batch.columns)).alias("_r")).select("_r.*")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            rows = rows.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
        rows.write.mode("append").parquet(path)

    return apply


def latest_stream(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, value, at): the newest value of each key, in update mode."""
    return events.groupBy(key).agg(F.max(F.struct(at, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col(f"m.{at}").alias(at))


def daily_counts_stream(events: DataFrame, at: str, kind: str, *, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, kind, n) for each window, final once the watermark has passed; later events are left out."""
    by = events.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), kind, "n")


def new_files_stream(spark, root: str, schema: str) -> DataFrame:
    """Rows of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).parquet(root)
