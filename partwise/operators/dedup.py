"""Deduplication by idempotency key in batch form. Input: p, entity, seq, off, failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import idempotency_key


def keys(s: DataFrame) -> DataFrame:
    return s.withColumn("key", idempotency_key())


def mark_duplicates(s: DataFrame) -> DataFrame:
    """duplicate: the key came earlier, whatever became of it."""
    return keys(s).withColumn("duplicate", F.row_number().over(Window.partitionBy("key").orderBy("off")) > 1)


def mark_after_success(s: DataFrame) -> DataFrame:
    """duplicate: the key was handled with success earlier (failed ones are not remembered)."""
    earlier = Window.partitionBy("key").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    return keys(s).withColumn("duplicate", F.coalesce(F.max(F.when(~F.col("failed"), True)).over(earlier), F.lit(False)))


def mark_within(s: DataFrame, retention: int) -> DataFrame:
    """duplicate: the key was handled with success at most retention offsets earlier; one older than that is forgotten."""
    earlier = Window.partitionBy("key").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(~F.col("failed"), F.col("off"))).over(earlier)
    return keys(s).withColumn("duplicate", F.coalesce(F.col("off") - last <= retention, F.lit(False)))


def evict(store: DataFrame, cutoff) -> DataFrame:
    """A key store (key, processed_at) without what was processed before cutoff; cutoff itself stays."""
    return store.where(F.col("processed_at") >= cutoff)


def store(s: DataFrame) -> DataFrame:
    """key, processed_at: what a store holds after s."""
    return keys(s).where(~F.col("failed")).groupBy("key").agg(F.max("off").alias("processed_at"))


def store_size(s: DataFrame) -> DataFrame:
    return keys(s).where(~F.col("failed")).groupBy("p").agg(F.count_distinct("key").alias("store_size"))


def late_dispositions(s: DataFrame) -> DataFrame:
    """Out-of-sequence events (below the anchor or after the release): DUPLICATE if their key was handled, else LATE_DROPPED."""
    from .sequence import dispositions

    d = mark_after_success(dispositions(s))
    late = d.where("disposition in ('BELOW_ANCHOR', 'AFTER_RELEASE')")
    return late.select("p", "off", "key", F.when(F.col("duplicate"), "DUPLICATE").otherwise("LATE_DROPPED").alias("outcome"))


def within_watermark(stream: DataFrame, delay: str, time: str = "timestamp") -> DataFrame:
    """The streaming fast path: keys are remembered on arrival for delay of event time."""
    return keys(stream).withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])
