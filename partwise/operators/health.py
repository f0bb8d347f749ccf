"""Partition health and degradation signals. Input: p, off (as seconds), failed, latency_ms."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPAN, block, carried, inside, with_halo

QUANTILES = ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))


def partition_health(s: DataFrame) -> DataFrame:
    """One row a partition: events, failures, error rate, nearest-rank percentiles and throughput. Sums up before its one
    shuffle but for the percentiles, whose counts by value do."""
    exact = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)").alias(n) for q, n in QUANTILES]
    span = F.max("off") - F.min("off")
    return s.groupBy("p").agg(
        F.count("*").alias("total_events"),
        F.count_if("failed").alias("failures"),
        (F.count_if("failed") / F.count("*")).alias("error_rate"),
        *exact,
        F.when(span > 0, F.count("*") / span).otherwise(F.count("*").cast("double")).alias("throughput"),
    )


def sliding_rates(s: DataFrame, window: int = 60, span: int = SPAN) -> DataFrame:
    """After each event: events and failures of the last window seconds, both ends included, and their rate."""
    f = inside().rangeBetween(-window, 0)
    n, bad = F.count("*").over(f), F.count(F.when(F.col("failed"), 1)).over(f)
    d = with_halo(s.select("p", "off", "failed"), window, span).withColumns({"n": n, "failures": bad})
    return d.where("not __halo").select("p", "off", "n", "failures").withColumn("error_rate", F.col("failures") / F.col("n"))


def sliding_percentiles(s: DataFrame, window: int = 60, span: int = SPAN) -> DataFrame:
    """After each event the exact percentiles of the last window seconds: a block's rows pass through one sorted list."""

    def slide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("off", kind="stable")
        off, values, halo = rows["off"].tolist(), rows["latency_ms"].tolist(), rows["__halo"].tolist()
        kept: list[float] = []
        first, out, k = 0, [], 0
        while k < len(off):
            end = k
            while end < len(off) and off[end] == off[k]:  # rows of one offset see each other
                if values[end] == values[end]:
                    insort(kept, values[end])
                end += 1
            while off[first] < off[k] - window:
                if values[first] == values[first]:
                    del kept[bisect_left(kept, values[first])]
                first += 1
            ranks = [kept[max(math.ceil(q * len(kept)), 1) - 1] if kept else None for q, _ in QUANTILES]
            out += [(off[i], *ranks) for i in range(k, end) if not halo[i]]
            k = end
        return pd.DataFrame(out, columns=["off", *(n for _, n in QUANTILES)]).assign(p=rows["p"].iloc[0])[["p", "off", *(n for _, n in QUANTILES)]]

    kind = s.schema["p"].dataType.simpleString()
    schema = f"p {kind}, off long, " + ", ".join(f"{n} double" for _, n in QUANTILES)
    return with_halo(s.select("p", "off", "latency_ms"), window, span).groupBy("p", "__block").applyInPandas(slide, schema)


def sliding_throughput(s: DataFrame, window: int = 60, span: int = SPAN) -> DataFrame:
    """Events a second over the last window seconds, or over the time since the partition's first event if shorter."""
    n = F.count("*").over(inside().rangeBetween(-window, 0))
    begun = s.groupBy("p").agg(F.min("off").alias("__begun"))
    df = with_halo(s.select("p", "off"), window, span).withColumn("n", n).where("not __halo").join(begun, "p").withColumn("elapsed", F.col("off") - F.col("__begun"))
    return df.select("p", "off", "n", F.when(F.col("elapsed") <= 0, F.col("n").cast("double")).otherwise(F.col("n") / F.least("elapsed", F.lit(window))).alias("throughput"))


def _before(df: DataFrame, value: Column, first, span: int) -> DataFrame:
    """Adds __now, the value, and __was, that of the row before in its partition (first where there is none)."""
    d = df.withColumns({"__now": value, "__block": block(span)})
    d = carried(d, F.max_by("__now", "off"), F.last, "__carry")
    return d.withColumn("__was", F.coalesce(F.lag("__now").over(inside()), "__carry", F.lit(first)))


def rising(df: DataFrame, exceeds: Column, span: int = SPAN) -> DataFrame:
    """The rows at which exceeds turns true in its partition."""
    return _before(df, exceeds, False, span).where("__now and not __was").drop("__now", "__was", "__block", "__carry")


def transitions(s: DataFrame, numerator: int = 3, denominator: int = 10, window: int = 60, span: int = SPAN) -> DataFrame:
    """Where the monitor alone would open and close a circuit: the rate rises to numerator / denominator, or falls below."""
    state = F.when(F.col("failures") * denominator >= F.col("n") * numerator, "OPEN").otherwise("CLOSED")
    return _before(sliding_rates(s, window, span), state, "CLOSED", span).where("__now <> __was").select("p", "off", F.col("__was").alias("from_state"), F.col("__now").alias("state"))


def error_signals(s: DataFrame, numerator: int = 5, denominator: int = 10, window: int = 60, span: int = SPAN) -> DataFrame:
    """ERROR_RATE signals: the rate rises to numerator / denominator or more (compared as integers)."""
    r = rising(sliding_rates(s, window, span), F.col("failures") * denominator >= F.col("n") * numerator, span)
    return r.select("p", "off", F.lit("ERROR_RATE").alias("type"), F.col("error_rate").alias("current_value"), F.lit(numerator / denominator).alias("threshold"))


def latency_signals(s: DataFrame, threshold: float = 5000.0, window: int = 60, span: int = SPAN) -> DataFrame:
    """LATENCY signals: the 99th percentile rises to threshold ms or more."""
    r = rising(sliding_percentiles(s, window, span), F.coalesce(F.col("p99") >= threshold, F.lit(False)), span)
    return r.select("p", "off", F.lit("LATENCY").alias("type"), F.col("p99").alias("current_value"), F.lit(float(threshold)).alias("threshold"))


def trial_statistics(df: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, sample deviation and 95 % interval of each group's trials (no margin for one), with percentiles."""
    n, mean, sd = F.count(value), F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    margin = F.when(n > 1, 1.96 * sd / F.sqrt(n)).otherwise(F.lit(0.0))
    exact = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(name) for q, name in QUANTILES]
    return df.groupBy(by).agg(n.alias("n"), mean.alias("mean"), sd.alias("sd"), (mean - margin).alias("low"), (mean + margin).alias("high"), *exact)
