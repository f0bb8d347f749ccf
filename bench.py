"""Times the headline queries, and the machine by itself; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import time
import tracemalloc

from pyspark.sql import SparkSession

from partwise.config import BreakerSettings, ConsumerSettings, ReorderSettings
from partwise.plans import catalog
from partwise.streaming.machine import Machine, PermanentProcessingException, Store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "partition_health",
    "reorder_dispositions",
    "sequence_gaps",
    "buffer_depth",
    "dedup_after_success",
    "sliding_error_rate",
    "sliding_percentiles",
    "error_rate_signals",
    "latency_signals",
    "dead_letter_headers",
    "event_counters",
    "json_envelope",
    "stateful_pipeline",
)


def event(offset: int, entity: str, seq: int, at: int) -> dict:
    return {"topic": "t", "offset": offset, "source_entity": entity, "sequence_number": seq, "payload": "x" * 128, "at": at}


def rank(values: list[float], q: float) -> float:
    return sorted(values)[int(q * (len(values) - 1))]


def measures() -> dict:
    """One partition's machine in this process, without Spark. Times named clock are of the rows' clock."""
    calm = BreakerSettings(error_rate_threshold=1.0, latency_threshold_ms=1e12)
    wide = ReorderSettings(max_buffer_size=10**6, timeout_ms=10**9)
    out, rng = {}, random.Random(1)

    # Reordering: batches of 100 shuffled numbers of an entity, an event a millisecond; how long events wait.
    m = Machine(Store(), lambda e: ("SUCCESS", 1.0), ConsumerSettings(breaker=calm, reorder=wide), 0)
    arrived, at = {}, 0
    began = time.perf_counter()
    for batch in range(200):
        for seq in rng.sample(range(batch * 100, batch * 100 + 100), 100) if batch else range(100):
            arrived[seq] = at
            m.event(event(at, "a", seq, at))
            at += 1
    took = time.perf_counter() - began
    waits = [r["emitted_at"] - arrived[r["sequence_number"]] for r in m.rows if r["disposition"] == "PROCESSED"]
    out |= {f"reorder_wait_p{p}_clock_ms": rank(waits, p / 100) for p in (50, 95, 99)} | {"reorder_events_per_sec": round(len(arrived) / took)}

    # Deduplication: the check of a key.
    times = []
    for seq in range(10_000):
        began = time.perf_counter()
        m._key(event(0, "a", seq, 0)) in m.s.seen  # noqa: B015
        times.append((time.perf_counter() - began) * 1000)
    out |= {"dedup_check_p50_ms": round(rank(times, 0.5), 4), "dedup_check_p99_ms": round(rank(times, 0.99), 4)}

    # Dead letters: every event but the first fails.
    def refuse(e):
        if e["offset"]:
            raise PermanentProcessingException("no")
        return "SUCCESS", 1.0

    m = Machine(Store(), refuse, ConsumerSettings(breaker=BreakerSettings(error_rate_threshold=1.0, latency_threshold_ms=1e12)), 0)
    began = time.perf_counter()
    for k in range(20_000):
        m.event(event(k, f"e{k % 100}", k // 100, k // 1000))
    out["dead_letters_per_sec"] = round(20_000 / (time.perf_counter() - began))

    # Recovery: from open to closed, events a millisecond apart, cooldown 30 s and ten probes.
    bad = [True]

    def shaky(e):
        if bad[0]:
            raise PermanentProcessingException("no")
        return "SUCCESS", 1.0

    m = Machine(Store(), shaky, ConsumerSettings(), 0)
    for k in range(40_000):
        m.event(event(k, f"e{k}", 1, k))
        bad[0] = False
    turns = {r["detail"]: r["emitted_at"] for r in m.rows if r["disposition"] == "TRANSITION"}
    out["recovery_clock_ms"] = turns["HALF_OPEN>CLOSED"] - turns["CLOSED>OPEN"]

    # Memory and time of buffered events: a hundred entities that each wait for number 2.
    for n in (10_000, 50_000):
        m = Machine(Store(), lambda e: ("SUCCESS", 1.0), ConsumerSettings(breaker=calm, reorder=wide), 0)
        for e in range(100):
            m.event(event(e, f"e{e}", 1, 0))
        rows = [event(100 + k, f"e{k % 100}", 3 + k // 100, k // 100) for k in range(n)]
        for r in rows:
            r["payload"] = f"{r['offset']:0128d}"
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        began = time.perf_counter()
        for r in rows:
            m.event(r)
        took = time.perf_counter() - began
        out[f"buffered_{n}_events_per_sec"] = round(n / took)
        out[f"buffered_{n}_bytes_per_event"] = round((tracemalloc.get_traced_memory()[0] - before) / n)
        tracemalloc.stop()
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["partition_health"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    rate = round(events / took["stateful_pipeline"])
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "stateful_events_per_sec": rate, "measures": measures()}))


if __name__ == "__main__":
    main()
