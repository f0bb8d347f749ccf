"""Offsets, metrics and health tables from handled events and breaker states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CIRCUIT_STATES


def committed_offsets(s: DataFrame) -> DataFrame:
    """The next offset of each partition."""
    return s.groupBy("p").agg((F.max("off") + 1).alias("next_offset"))


def counters(handled: DataFrame) -> DataFrame:
    """events processed and failed, and dead letters by classification, a row a partition."""
    kinds = [F.count_if(F.col("classification") == k).alias(f"dlq_{k.lower()}") for k in ("DESERIALIZATION", "VALIDATION", "TRANSIENT", "PERMANENT")]
    return handled.groupBy("p").agg(F.count_if("ok").alias("events_processed"), F.count_if(~F.col("ok")).alias("events_failed"), *kinds)


def latency_timer(handled: DataFrame) -> DataFrame:
    """Latency of successes only."""
    exact = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return handled.where("ok").groupBy("p").agg(F.count("*").alias("n"), *exact)


def gauges(transitions: DataFrame, depths: DataFrame, stores: DataFrame) -> DataFrame:
    """circuit_state (0 closed, 1 open, 2 half open), buffer_depth and store_size of each partition, as they are last."""
    order = F.array(*(F.lit(x) for x in CIRCUIT_STATES))
    state = transitions.groupBy("p").agg((F.array_position(order, F.max_by("state", "off")) - 1).cast("int").alias("circuit_state"))
    deep = depths.groupBy("p").agg(F.max_by("depth", "off").alias("buffer_depth"))
    return deep.join(stores, "p", "left").join(state, "p", "left").select("p", F.coalesce("circuit_state", F.lit(0)).alias("circuit_state"), "buffer_depth", F.coalesce("store_size", F.lit(0)).cast("long").alias("store_size"))


def transition_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("p", "from_state", "state").agg(F.count("*").alias("n"))


def health_indicator(states: DataFrame, topic: str) -> DataFrame:
    """One row: DOWN if a partition is OPEN, else UP; partitions by state, zeros too; the open ones by name. It sums up
    one row a partition."""
    counts = [F.count_if(F.col("state") == k).alias(k.lower()) for k in CIRCUIT_STATES]
    opened = F.array_join(F.sort_array(F.collect_list(F.when(F.col("state") == "OPEN", F.concat_ws("-", F.lit(topic), F.col("p").cast("string"))))), ",")
    return states.agg(F.when(F.count_if(F.col("state") == "OPEN") > 0, "DOWN").otherwise("UP").alias("status"), *counts, opened.alias("open_partitions"))


def health_status(states: DataFrame, depths: DataFrame, group: str, status: str = "UNKNOWN") -> DataFrame:
    """One row for a consumer group: its status, its number of partitions, and their states and depths as maps."""
    joined = states.select("p", "state").join(depths.groupBy("p").agg(F.max_by("depth", "off").alias("depth")), "p", "full")
    pair = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", value))))
    return joined.agg(
        F.lit(group).alias("consumer_group"),
        F.lit(status).alias("status"),
        F.count("*").alias("partitions"),
        pair(F.coalesce("state", F.lit("CLOSED")).alias("state")).alias("states"),
        pair(F.coalesce("depth", F.lit(0)).cast("long").alias("depth")).alias("depths"),
    )
