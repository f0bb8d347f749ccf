"""Generators of test streams. They are plain functions with the checks that a trigger endpoint would make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import POISON

MOST = 10_000


def _checked(account: str, count: int) -> None:
    if not account or not account.strip():
        raise ValueError("the account is blank")
    if not 1 <= count <= MOST:
        raise ValueError(f"count is from 1 to {MOST}")


def _payments(df: DataFrame, account: str) -> DataFrame:
    seq = F.col("sequence_number")
    pick = lambda names: F.element_at(F.array(*(F.lit(x) for x in names)), (seq % len(names) + 1).cast("int"))
    return df.select(
        F.lit(account).alias("account_id"),
        "sequence_number",
        ((seq * 7919 % 100_000) / F.lit(100)).cast("decimal(18,2)").alias("amount"),
        pick(("USD", "EUR", "GBP")).alias("currency"),
        pick(("CREDIT", "DEBIT")).alias("type"),
        "arrival",
    )


def sequenced(spark: SparkSession, account: str, count: int) -> DataFrame:
    """Events 1 to count in order."""
    _checked(account, count)
    return _payments(spark.range(1, count + 1).select(F.col("id").alias("sequence_number"), F.col("id").alias("arrival")), account)


def out_of_order(spark: SparkSession, account: str, count: int, batch: int = MOST, seed: int = 17) -> DataFrame:
    """Events 1 to count, arriving in an order of their hashes within each batch of events."""
    _checked(account, count)
    seq = F.col("id")
    jitter = F.pmod(seq * 7919 + seed * 104729, F.lit(1009)) * MOST + seq
    order = F.floor((seq - 1) / batch) * (1009 * MOST * 10) + jitter
    return _payments(spark.range(1, count + 1).select(seq.alias("sequence_number"), order.cast("long").alias("arrival")), account)


def duplicates(spark: SparkSession, account: str, count: int, copies: int = 1) -> DataFrame:
    """Each event 1 + copies times."""
    _checked(account, count)
    df = spark.range(1, count + 1).select(F.col("id").alias("sequence_number"), F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"))
    return _payments(df.select("sequence_number", (F.col("sequence_number") * (copies + 1) + F.col("copy")).cast("long").alias("arrival")), account)


def poison_pill(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("poison").alias("key"), F.lit(POISON).alias("value"))
