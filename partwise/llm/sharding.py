"""Sharding by sampled splitters: shards of nearly equal bytes, made of ranges of a key.

The key is (hash of the text, doc_id): equal texts lie side by side, and a group of copies too large for a shard is cut
between its documents. The law is `bytes`.

1. A narrow table (doc_id, size, text_crc32, key) is written; texts are read once and never shuffled.
2. A size-weighted sample of keys is drawn: a record is drawn if its own hash is below SAMPLE * ranges * size / total, so
   the sample is the same in every run and holds about SAMPLE keys a range, however many rows there are.
3. Quantiles of the sample are the splitters of the ranges, as many as there are shuffle partitions (or shards, if more).
   They stand between groups of equal texts. Ranges of over OVERFULL times their share are subdivided by splitters from
   a denser sample of their own records, twice as dense each time, and these may cut a group; a range that no sample
   of the most density cuts fails loudly.
4. Records are dealt by range; within a range their running bytes, with the ranges' totals before them, give each
   record's place in the whole order, and that place its shard. What meets at the driver are samples and one total a range.
   Equal texts of up to WHOLE of a shard's bytes in their range share the place of their middle, so they are in one shard.

Shards differ by at most a record's size and twice WHOLE of a shard. Defined cases: null text has no bytes (size EXTRA, crc32 0); a null doc_id sorts
first among equal texts; repeated rows are records of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, EXTRA, SAMPLE, OVERFULL = 40, 16, 32, 2.0
WHOLE = 0.01  # of a shard: equal texts of up to so many bytes are not cut
FLOOR = -(1 << 63)


def _range_of(key: np.ndarray, doc: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters (rows of key, doc) are at or below each record."""
    lo = np.searchsorted(splitters[:, 0], key, "left")
    hi = np.searchsorted(splitters[:, 0], key, "right")
    out = lo.copy()
    tied = np.flatnonzero(hi > lo)
    for at in np.unique(lo[tied]):
        rows = tied[lo[tied] == at]
        out[rows] = at + np.searchsorted(splitters[at : hi[rows[0]], 1], doc[rows], "right")
    return out


def _ranged(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def range_of(key: pd.Series, doc: pd.Series) -> pd.Series:
        return pd.Series(_range_of(key.to_numpy(), doc.to_numpy(), splitters).astype(np.int32))

    return records.withColumn("range", range_of("key", "place"))


def _sample(records: DataFrame, rate: float) -> np.ndarray:
    """Keys drawn with a chance of rate a byte."""
    chance = F.pmod(F.xxhash64("key", "place", F.lit(7)), F.lit(1 << 53)) / float(1 << 53)
    drawn = records.where(chance < F.col("size") * F.lit(rate)).select("key", "place").distinct().toPandas()
    out = drawn.to_numpy(dtype=np.int64).reshape(-1, 2)
    return np.unique(out, axis=0)


def _quantiles(sample: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(1, n) * len(sample) // max(n, 1)
    return np.unique(sample[at[at < len(sample)]], axis=0) if len(sample) else sample


def splitters(records: DataFrame, total: int, ranges: int, passes: int = 10) -> tuple[np.ndarray, dict[int, int]]:
    """Splitters under which no range of more than one record is overfull, and each range's bytes under them."""
    first = _quantiles(_sample(records, SAMPLE * ranges / max(total, 1)), ranges)
    if len(first):
        first[:, 1] = FLOOR  # ranges begin with a group
    cuts, density = np.unique(first, axis=0), 4 * SAMPLE
    for _ in range(passes):
        ranged = _ranged(records, cuts)
        rows = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min(F.struct("key", "place")).alias("low"), F.max(F.struct("key", "place")).alias("high")).collect()
        over = [r["range"] for r in rows if r["bytes"] > OVERFULL * total / ranges and r["low"] != r["high"]]
        if not over:
            return cuts, {r["range"]: r["bytes"] for r in rows}
        share = sum(r["bytes"] for r in rows if r["range"] in set(over)) * ranges / max(total, 1)
        dense = _sample(ranged.where(F.col("range").isin(over)), density * ranges / max(total, 1))
        inner = _quantiles(dense, int(4 * share) + 2)
        # Cut before and after each, so that rows repeated in great number come to lie alone.
        cuts, density = np.unique(np.concatenate((cuts, inner, inner + np.array([0, 1]))), axis=0), 2 * density
    raise RuntimeError(f"{len(over)} ranges are still overfull after {passes} passes")


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every record."""
    from .shared import parallelism, written

    text = F.coalesce(F.col("text"), F.lit(""))
    records = written(
        documents.select(
            "doc_id",
            (F.octet_length(text) + EXTRA).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(FLOOR)).alias("place"),
        ),
        "sharding",
    )
    spark = documents.sparkSession
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts, sums = splitters(records, total, max(shards, parallelism(spark)))
    start, begins = 0, {}
    for k in range(len(cuts) + 1):
        begins[k] = start
        start += sums.get(k, 0)
    before = spark.createDataFrame([(k, v) for k, v in begins.items()], "range int, before long")
    order = Window.partitionBy("range").orderBy("key", "place")
    running = _ranged(records, cuts).withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    alike = Window.partitionBy("range", "key")
    group, end = F.sum("size").over(alike), F.max("upto").over(alike)
    whole = group <= F.lit(WHOLE * total / shards)
    middle = F.col("before") + F.when(whole, end - group / F.lit(2.0)).otherwise(F.col("upto") - F.col("size") / F.lit(2.0))  # of the record, or its group
    place = F.floor(middle * F.lit(shards / max(total, 1))).cast("int")
    dealt = running.join(F.broadcast(before), "range").withColumn("shard", F.least(place, F.lit(shards - 1)))
    inside = Window.partitionBy("range", "shard").orderBy("key", "place")
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "range", "shard", F.row_number().over(inside).alias("nth")), "sharding")
    # A shard's slots follow its ranges; there are at most ranges + shards of these counts.
    counts = sorted((r["shard"], r["range"], r["n"]) for r in dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).collect())
    rows, last, at = [], None, 0
    for s, r, n in counts:
        at = at if s == last else 0
        rows.append((s, r, at))
        last, at = s, at + n
    slots = spark.createDataFrame(rows, "shard int, range int, first long")
    return dealt.join(F.broadcast(slots), ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

