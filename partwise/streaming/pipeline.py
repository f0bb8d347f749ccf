"""The pipeline: parse, split off what cannot be parsed, run the partitions, and write rows where they belong."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConsumerSettings
from ..operators.dead_letters import as_records, headers, topic_of
from ..schema import CIRCUIT_STATES, OUTPUT
from ..sources import streams
from .metrics import Metrics
from .processor import PartitionProcessor
from .sinks import DeadLetterSink, by_topic

CONTROL = "topic string, partition int, command string, payload string"
LAST = (1 << 63) - 1  # the offset of a command: after the rows of its micro-batch
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parsed(raw: DataFrame, parse: Callable[[DataFrame], DataFrame] = streams.from_json) -> tuple[DataFrame, DataFrame]:
    """(events, failures): failures bypass every later stage, the health window too."""
    df = parse(raw)
    columns = ["topic", "partition", "offset", "source_entity", "sequence_number", F.col("value").cast("string").alias("payload"), "timestamp", F.lit(None).cast("string").alias("command")]
    return df.where("parse_ok").select(*columns), df.where("not parse_ok").select(*columns)


def unparsed_letters(failures: DataFrame) -> DataFrame:
    """Output rows of records that no parser takes."""
    fill = {
        "disposition": F.lit("DLQ"),
        "stage": F.lit("DESERIALIZE"),
        "classification": F.lit("DESERIALIZATION"),
        "error_class": F.lit("DeserializationException"),
        "error_message": F.concat(F.lit("cannot be read: partition="), "partition", F.lit(" offset="), "offset"),
        "retry_count": F.lit(0),
        "emitted_at": F.col("timestamp"),
    }
    out = []
    for name, kind in (c.strip().split(" ") for c in OUTPUT.split(",")):
        value = fill.get(name, F.col(name) if name in failures.columns else F.lit(None))
        out.append(value.cast(kind).alias(name))
    return failures.select(*out)


def commands(stream: DataFrame) -> DataFrame:
    """Rows (topic, partition, command, payload) as events: FLUSH, CLEAR, RESET, UNSUPPRESS, SNAPSHOT or RESTORE."""
    return stream.select(
        "topic",
        "partition",
        F.lit(LAST).alias("offset"),
        F.lit(None).cast("string").alias("source_entity"),
        F.lit(0).cast("long").alias("sequence_number"),
        "payload",
        F.lit(None).cast("timestamp").alias("timestamp"),
        "command",
    )


def command(spark: SparkSession, folder: str, name: str, partitions: Iterable[tuple[str, int]], payload: str | None = None) -> None:
    """Tells a running pipeline that listens to folder to do name with partitions."""
    rows = [(topic, p, name, payload) for topic, p in partitions]
    spark.createDataFrame(rows, CONTROL).coalesce(1).write.mode("append").json(folder)


def process(events: DataFrame, handler: Callable[[dict], Any], settings: ConsumerSettings = ConsumerSettings(), flush: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """Runs events through one stateful operator; one shuffle by (topic, partition). initial: topic, partition, state (the
    detail of SNAPSHOT rows) that a new stream starts from."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if "command" not in events.columns:
        events = events.withColumn("command", F.lit(None).cast("string"))
    if not events.isStreaming:
        spark.streams.active  # noqa: B018 - makes the state store's coordinator for a batch query
        # Sorted before the operator, so that it takes a partition in chunks. With a number Spark does not join small shuffle
        # partitions, whose topic partitions would then go through one task.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = events.repartition(tasks, "topic", "partition").sortWithinPartitions("topic", "partition", "offset")
        return ordered.groupBy("topic", "partition").transformWithStateInPandas(PartitionProcessor(handler, settings, flush, False), OUTPUT, "Append", "None")
    state = None if initial is None else initial.select("topic", "partition", "state").groupBy("topic", "partition")
    return events.groupBy("topic", "partition").transformWithStateInPandas(PartitionProcessor(handler, settings), OUTPUT, "Append", "ProcessingTime", state)


def letters(rows: DataFrame, topic_settings) -> DataFrame:
    """Dead letters of output rows for a Kafka-shaped sink; the payload is kept."""
    bad = rows.where("disposition = 'DLQ'").withColumnsRenamed({"partition": "p", "offset": "off", "source_entity": "entity"})
    named = bad.withColumns({"key": F.col("entity"), "value": F.col("payload").cast("binary"), "destination": topic_of(F.col("classification"), topic_settings)})
    named = named.withColumn("headers", headers("", F.unix_timestamp("emitted_at")))
    named = named.withColumn("headers", F.map_zip_with("headers", F.create_map(F.lit("x-dlq-original-topic"), F.col("topic")), lambda k, a, b: F.coalesce(b, a)))
    return as_records(named)


def write_batch(settings: ConsumerSettings, path: str, format: str = "parquet", sink: DeadLetterSink | None = None, metrics: Metrics | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows by disposition, dead letters by topic. A batch that is run again replaces its own output,
    so what is written is exactly once; letters that a sink sends are sent at least once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            now = int(time.time() * 1000)
            if sink:
                sink.retry(now, f"batch={batch_id}-retry")
            if batch.isEmpty():  # a batch for timers only
                return
            batch.write.mode("overwrite").partitionBy("disposition").format(format).save(f"{path}/rows/batch={batch_id}")
            if metrics:
                metrics.update(batch)
            out = letters(batch, settings.dead_letters)
            if out.isEmpty():
                return
            if sink:
                sink.route(out, now, f"batch={batch_id}")
            else:
                by_topic(f"{path}/letters", format)(out, f"batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def run(
    raw: DataFrame,
    handler: Callable[[dict], Any],
    settings: ConsumerSettings,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "1 second",
    control: str | None = None,
    send: Callable[[DataFrame, str], None] | None = None,
    metrics: Metrics | None = None,
    initial: DataFrame | None = None,
):
    """Starts the streaming pipeline; its checkpoint has offsets and state together. control: a folder of commands; send: where
    dead letters go (default: a table by topic in path), with a staging area in path for when it fails. Stop with
    lifecycle.stop(). A run of what is available leaves timers to the next one."""
    spark = raw.sparkSession
    events, failures = parsed(raw)
    if control:
        events = events.unionByName(commands(spark.readStream.schema(CONTROL).json(control)))
    rows = process(events, handler, settings, initial=initial)
    sink = (lambda name: DeadLetterSink(spark, send, f"{path}/staged/{name}", settings.dead_letters)) if send else lambda name: None
    write = rows.writeStream.foreachBatch(write_batch(settings, path, sink=sink("rows"), metrics=metrics)).option("checkpointLocation", f"{checkpoint}/rows").outputMode("append")
    bad = unparsed_letters(failures).writeStream.foreachBatch(write_batch(settings, f"{path}/unparsed", sink=sink("unparsed"), metrics=metrics)).option("checkpointLocation", f"{checkpoint}/unparsed").outputMode("append")
    # Timers by processing time make a batch at every trigger; one that ends with what is available must not wait for them.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not available_now).lower())
    when = {"availableNow": True} if available_now else {"processingTime": interval}
    return write.trigger(**when).start(), bad.trigger(**when).start()


def run_batch(spark: SparkSession, raw: DataFrame, handler: Callable[[dict], Any], settings: ConsumerSettings = ConsumerSettings()) -> DataFrame:
    """The same over a batch of raw records, with the buffers flushed at the end."""
    events, failures = parsed(raw)
    return process(events, handler, settings, flush=True).unionByName(unparsed_letters(failures))


def snapshot(spark: SparkSession, checkpoint: str, variable: str, partition: int | None = None) -> DataFrame:
    """What a checkpoint holds of a state variable (core, entities, heads, buffer, seen, window or held), of one partition if
    wanted."""
    found = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    return found if partition is None else found.where(F.col("key.partition") == partition)


def gauges(spark: SparkSession, checkpoint: str) -> DataFrame:
    """topic, partition, circuit_state (0 closed, 1 open, 2 half open), buffer_depth and store_size, as a checkpoint has them."""
    core = F.from_json(F.col("value.json"), "state string, count long")
    states = snapshot(spark, checkpoint, "core").select(F.col("key.topic").alias("topic"), F.col("key.partition").alias("partition"), core.alias("core"))
    order = F.array(*(F.lit(x) for x in CIRCUIT_STATES))
    keys = snapshot(spark, checkpoint, "seen").groupBy(F.col("key.topic").alias("topic"), F.col("key.partition").alias("partition")).agg(F.count("*").alias("store_size"))
    named = states.select("topic", "partition", (F.array_position(order, F.col("core.state")) - 1).cast("int").alias("circuit_state"), F.col("core.count").alias("buffer_depth"))
    return named.join(keys, ["topic", "partition"], "left").fillna(0, ["store_size"])
