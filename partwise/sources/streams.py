"""Sources: Kafka-shaped streams, header and JSON envelopes, and the stream view of an events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PAYMENT, RAW


def subscribe(
    spark: SparkSession,
    topics: list[str],
    bootstrap: str = "",
    format: str = "kafka",
    path: str = "",
    max_records: int = 1_000_000,
    starting: str = "earliest",
    group: str | None = None,
    max_files: int = 1,
) -> DataFrame:
    """A stream of raw records of topics. max_records: of a micro-batch, over all partitions; starting: earliest, latest, or
    offsets by topic and partition as JSON, for a pipeline without a checkpoint; group: the consumer group's name at the broker.
    Any other format reads RAW-shaped files from path, max_files in a micro-batch."""
    if not topics:
        raise ValueError("no topics to subscribe to")
    if max_records < 1 or max_files < 1:
        raise ValueError("a micro-batch takes one record or file at least")
    if format == "kafka":
        options = {"kafka.bootstrap.servers": bootstrap, "subscribe": ",".join(topics), "startingOffsets": starting, "includeHeaders": "true", "maxOffsetsPerTrigger": str(max_records)}
        return spark.readStream.format("kafka").options(**options, **({"kafka.group.id": group} if group else {})).load()
    return spark.readStream.format(format).schema(RAW).option("maxFilesPerTrigger", str(max_files)).load(path).where(F.col("topic").isin(topics))


def last_header(name: str, headers: Column | None = None) -> Column:
    """The text of the last header of that name; empty if there is none."""
    headers = F.col("headers") if headers is None else headers
    found = F.filter(headers, lambda h: h["key"] == name)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"].cast("string"), F.lit(""))


def from_headers(raw: DataFrame, entity: str = "x-source-entity", sequence: str = "x-sequence-number") -> DataFrame:
    """source_entity and sequence_number from headers; parse_ok is false where the number is missing or none."""
    number = F.expr("try_cast(__seq AS BIGINT)")
    df = raw.withColumn("source_entity", last_header(entity)).withColumn("__seq", last_header(sequence)).withColumn("sequence_number", number)
    return df.withColumn("parse_ok", F.col("sequence_number").isNotNull()).drop("__seq")


def from_json(raw: DataFrame, schema=PAYMENT, entity: str = "accountId", sequence: str = "sequenceNumber") -> DataFrame:
    """The value as JSON: payload, source_entity, sequence_number and parse_ok (both are there)."""
    df = raw.withColumn("payload", F.from_json(F.col("value").cast("string"), schema))
    df = df.withColumns({"source_entity": F.col("payload")[entity], "sequence_number": F.col("payload")[sequence]})
    return df.withColumn("parse_ok", F.col("source_entity").isNotNull() & F.col("sequence_number").isNotNull())


def stream_view(events: DataFrame) -> DataFrame:
    """A disordered stream with gaps and duplicates made from an events table: p, entity, seq, off, event_id, event_type,
    failed, latency_ms, copy, props."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    base = events.select(
        "event_id",
        "event_type",
        F.col("value").alias("latency_ms"),
        "props",
        (F.col("user_id") % 6).alias("p"),
        F.col("user_id").cast("string").alias("entity"),
        F.row_number().over(own).cast("long").alias("seq"),
        (F.col("event_id") + (F.col("event_id") * 7919) % 1009).alias("arrival"),
    ).where("event_id % 50 <> 7")
    # Every event once, and every twentieth a second time later: one pass, no union of two scans.
    copies = F.when(F.col("event_id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = base.withColumn("copy", F.explode(copies)).withColumn("arrival", F.col("arrival") + 300 * F.col("copy"))
    place = Window.partitionBy("p").orderBy("arrival", "event_id", "copy")
    return twice.withColumns({"off": F.row_number().over(place).cast("long"), "failed": F.col("event_type") == "error"}).drop("arrival")


def raw_view(events: DataFrame, topic: str = "events") -> DataFrame:
    """The stream view as raw records: a JSON value (every 97th broken) and headers."""
    s = stream_view(events)
    good = F.to_json(F.struct(F.col("entity").alias("accountId"), F.col("seq").alias("sequenceNumber"), F.col("latency_ms").cast("decimal(18,2)").alias("amount"), F.lit("USD").alias("currency"), F.when(F.col("failed"), "DEBIT").otherwise("CREDIT").alias("type")))
    value = F.when(F.col("event_id") % 97 == 3, F.lit(POISON)).otherwise(good)
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    headers = F.array(header("x-source-entity", F.lit("shadowed")), header("x-source-entity", F.col("entity")), header("x-sequence-number", F.col("seq").cast("string")))
    return s.select(
        F.col("entity").alias("key"),
        F.encode(value, "UTF-8").alias("value"),
        F.lit(topic).alias("topic"),
        F.col("p").cast("int").alias("partition"),
        F.col("off").alias("offset"),
        F.timestamp_seconds(1704067200 + F.col("off")).alias("timestamp"),
        F.when(F.col("event_id") % 89 == 5, F.slice(headers, 1, 2)).otherwise(headers).alias("headers"),
        "event_id",
    )


# Fixed value: a record that no parser takes.
POISON = "NOT_VALID_JSON{{{garbage!!!"
