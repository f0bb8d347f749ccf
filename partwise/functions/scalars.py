"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idempotency_key(entity="entity", seq="seq", partition="p") -> Column:
    """entity:seq:partition; the topic is no part of it."""
    return F.concat_ws(":", entity, F.col(seq).cast("string"), F.col(partition).cast("string"))


def correlation_id(topic: Column, partition="p", offset="off") -> Column:
    """The same id for a record in every run."""
    return F.sha2(F.concat_ws("|", topic, F.col(partition).cast("string"), F.col(offset).cast("string")), 256)


def backoff(initial: int, longest: int, attempts: Column) -> Column:
    """min(initial * 2 ** min(attempts, 20), longest)."""
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), F.least(attempts, F.lit(20))), F.lit(longest)).cast("long")


def retry_attempts(initial: int, longest: int, most: int, sleep: int = 50) -> int:
    """How often an event that always fails for a while is tried: each backoff of up to sleep ms gives one more attempt."""
    attempts, wait = 1, initial
    while attempts <= most and min(wait, longest) <= sleep:
        attempts, wait = attempts + 1, min(wait * 2, longest)
    return attempts


def attempts(initial: Column, longest: Column, most: Column, sleep: int = 50) -> Column:
    """retry_attempts() of columns; most is at most 10."""
    short = lambda k: F.least(initial * F.pow(F.lit(2.0), k), longest) <= sleep
    step = lambda acc, k: F.when((acc == k + 1) & (k < most) & short(k), acc + 1).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(1), step).cast("long")


def classify(error: Column) -> Column:
    """The classification of an error's class; PERMANENT for any other."""
    kinds = F.when(error == "TransientProcessingException", "TRANSIENT").when(error == "PermanentProcessingException", "PERMANENT")
    return F.when(error.isNull(), F.lit(None)).otherwise(kinds.when(error == "DeserializationException", "DESERIALIZATION").when(error == "ValidationException", "VALIDATION").otherwise("PERMANENT"))


def probe_decision(total: Column, success: Column, failure: Column, timed_out: Column) -> Column:
    """The state after a probe: no events close it; a failure or a time-out with events opens it."""
    ok = F.when(total == 0, True).when(failure > 0, False).when(timed_out, False).otherwise(success > 0)
    return F.when(ok, "CLOSED").otherwise("OPEN")
