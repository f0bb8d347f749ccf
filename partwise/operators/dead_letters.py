"""Dead-letter routing. Input: handled events (p, off, entity, error_class, error_message, classification, retry_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DeadLetterSettings
from ..functions.scalars import backoff, correlation_id

MESSAGE_LENGTH = 1000
# The names of a dead letter's headers.
HEADERS = (
    "x-dlq-original-topic",
    "x-dlq-original-partition",
    "x-dlq-original-offset",
    "x-dlq-error-classification",
    "x-dlq-failure-timestamp",
    "x-dlq-retry-count",
    "x-dlq-source-entity",
    "x-dlq-exception-class",
    "x-dlq-exception-message",
    "x-dlq-correlation-id",
)


def topic_of(classification: Column, settings: DeadLetterSettings) -> Column:
    """The topic of a classification; the default for those without."""
    out = F.lit(None).cast("string")
    for kind, topic in sorted(settings.topics.items()):
        out = F.when(classification == kind, topic).otherwise(out)
    return F.coalesce(out, F.lit(settings.default_topic))


def headers(topic: str, seconds: Column) -> Column:
    """The headers of a dead letter as a map; missing texts are empty, and a message is cut at MESSAGE_LENGTH."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = (
        F.lit(topic),
        text("p"),
        text("off"),
        text("classification"),
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        text("retry_count"),
        text("entity"),
        text("error_class"),
        F.substring(text("error_message"), 1, MESSAGE_LENGTH),
        correlation_id(F.lit(topic)),
    )
    return F.map_from_arrays(F.array(*(F.lit(h) for h in HEADERS)), F.array(*values))


def route(handled: DataFrame, topic: str, seconds: Column, settings: DeadLetterSettings = DeadLetterSettings()) -> DataFrame:
    """One dead letter for each failed event: its key, destination and headers; the place of the original is kept."""
    failed = handled.where("classification is not null")
    return failed.select(F.col("entity").alias("key"), topic_of(F.col("classification"), settings).alias("destination"), "p", "off", "classification", "retry_count", headers(topic, seconds).alias("headers"))


def buffered(letters: DataFrame, capacity: int) -> DataFrame:
    """What becomes of letters while the sink is down: the first capacity of each partition's are kept, the rest refused."""
    place = F.row_number().over(Window.partitionBy("p").orderBy("off"))
    return letters.withColumn("routing", F.when(place <= capacity, "BUFFERED").otherwise("BUFFER_FULL"))


def retry_due(entries: DataFrame, now: int, settings: DeadLetterSettings = DeadLetterSettings()) -> DataFrame:
    """One pass over buffered entries (attempts, last_attempt ms): which are due, and after how many attempts to alert."""
    wait = backoff(settings.initial_backoff_ms, settings.max_backoff_ms, F.col("attempts"))
    return entries.withColumns({"due": F.col("last_attempt") + wait <= now, "alert": F.col("attempts") + 1 > settings.max_route_attempts})


def as_records(letters: DataFrame) -> DataFrame:
    """Letters as rows for a Kafka sink: key, value, topic, headers."""
    pairs = F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")))
    value = F.col("value") if "value" in letters.columns else F.lit(None).cast("binary")
    return letters.select("key", value.alias("value"), F.col("destination").alias("topic"), pairs.alias("headers"))
