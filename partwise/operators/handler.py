"""The handler's outcome in batch form. Input: event_id, failed, p, off and what a fixture handler needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DeadLetterSettings
from ..functions.scalars import classify, retry_attempts


def fixture_outcome() -> tuple[Column, Column, Column]:
    """(result, error class, message) of the fixture handler: failed events raise one of four errors."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("TransientProcessingException", "PermanentProcessingException", "ValidationException", "IllegalStateException"))), (F.col("event_id") % 4 + 1).cast("int"))
    error = F.when(F.col("failed"), kind)
    return F.when(~F.col("failed"), "SUCCESS"), error, F.when(F.col("failed"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" failed")))


def handle(s: DataFrame, outcome: Callable[[], tuple[Column, Column, Column]] = fixture_outcome, settings: DeadLetterSettings = DeadLetterSettings()) -> DataFrame:
    """Adds ok, error_class, error_message, classification, attempts and retry_count. A result other than SUCCESS without an
    error is a permanent failure. What fails for a while is tried again while the backoff is short; then retry_count is the
    number of attempts; other failures are not retried."""
    result, error, message = outcome()
    n = retry_attempts(settings.initial_backoff_ms, settings.max_backoff_ms, settings.max_retry_count, settings.max_sleep_ms)
    kind = F.when(error.isNotNull(), error).when(F.coalesce(result, F.lit("")) != "SUCCESS", "PermanentProcessingException")
    df = s.withColumns({"error_class": kind, "error_message": message})
    passing = F.col("error_class") == "TransientProcessingException"
    return df.withColumns(
        {
            "ok": F.col("error_class").isNull(),
            "classification": classify(F.col("error_class")),
            "attempts": F.when(passing, n).otherwise(1),
            "retry_count": F.when(passing, n).otherwise(0),
        }
    )
