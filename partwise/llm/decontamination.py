"""Benchmark decontamination by winnowing.

1. Fingerprints. Texts are cut into words; of every WINDOW consecutive words the least hash of its GRAM-word grams is kept
   (winnowing: any shared span of WINDOW words shares a kept hash). A window of the benchmark is a row (n, kept, window,
   items): its number of words, its kept hash, the hash of the whole window, and the items that have it. Items of fewer than
   WINDOW words are one window of their own length, which is its own kept hash.
2. Screen. The kept hashes of the benchmark are set in a bitmap of SCREEN times as many bits, MOST_BITS at most, which is all
   that travels with the tasks; a document's kept hashes that are not in it are dropped where they are made.
3. Join. The kept hashes left over are joined with the benchmark's, each hit extended to its whole window: an equi-join on
   (n, kept, window). The benchmark's windows are broadcast if they come to SMALL_BYTES at most, measured first; else both
   sides are shuffled by that key, where Spark may split a hot one. Nothing of the benchmark but the bitmap meets the driver.
4. The hits of a document meet by a key made for its row: covered words, and the distinct items.

Texts are read once; what is written between is a row a document with its screened hashes.

Defined cases: null or empty text: no words, nothing hit, not contaminated. Repeated rows each get their own row. An empty
benchmark hits nothing. Null benchmark texts or items are no windows; item_ids are taken as strings. Other columns of the
inputs are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import beside, written

WINDOW, GRAM = 13, 8
SCREEN, LEAST_BITS, MOST_BITS, SMALL_BYTES = 32, 1 << 16, 1 << 27, 16 << 20
RULE = 20  # contaminated: n_hit > 0 and RULE * n_hit >= n_words
CANDIDATES = "array<struct<n:int,kept:bigint,window:bigint,start:int>>"


def _words(column):
    lower, wordy = K.lower_table(), K.alphanumeric()
    for i, j, data, offsets in K.chunks(column):
        data = lower[data]
        starts, ends = K.word_spans(data, wordy)
        yield i, j, K.word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def least(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of every width consecutive values, by doubling."""
    out, have = grams, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


def kept_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The kept hash of each window of n words h."""
    return least(K.gram_hashes(h, GRAM), WINDOW - GRAM + 1) if n == WINDOW else K.gram_hashes(h, n)


def _windows(batches):
    names = ["n", "kept", "window", "item"]
    for b in batches:
        parts = []
        for i, j, h, bounds in _words(b.column(1)):
            for d in range(j - i):
                own = h[bounds[d] : bounds[d + 1]]
                if len(own):
                    n = min(len(own), WINDOW)
                    parts.append((n, kept_hashes(own, n), K.gram_hashes(own, n), b.column(0)[i + d].as_py()))
        size = [len(p[1]) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([p[0] for p in parts], size).astype(np.int32)),
                *(pa.array(K.signed(np.concatenate([p[k] for p in parts])) if parts else [], pa.int64()) for k in (1, 2)),
                pa.array([p[3] for p, m in zip(parts, size, strict=True) for _ in range(m)], pa.string()),
            ],
            names,
        )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """n, kept, window, items: the distinct windows of the benchmark."""
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    found = rows.mapInArrow(_windows, "n int, kept long, window long, item string")
    return written(found.groupBy("n", "kept", "window").agg(F.collect_set("item").alias("items")), "decontaminate")


def screen_of(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bitmap of the kept hashes, as bytes, and the windows' lengths."""
    lengths, n = sorted(r["n"] for r in windows.select("n").distinct().collect()), windows.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, SCREEN * n):
        bits *= 2
    at = F.col("kept").bitwiseAND(F.lit(bits - 1))
    row = windows.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(kept & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[row["at"].to_numpy(np.int64)] = row["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8), lengths


def _in_screen(screen: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(len(screen) * 8 - 1)).astype(np.int64)
    return np.flatnonzero(screen[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def candidates(screen: np.ndarray, lengths: list[int], h: np.ndarray, bounds: np.ndarray):
    """(first word, n, kept, window) of the windows of words h whose kept hash passes the screen; bounds separate texts."""
    doc_end = np.repeat(bounds[1:], np.diff(bounds))
    out, g = [], h
    for n in range(1, max([min(n, GRAM) if n == WINDOW else n for n in lengths], default=0) + 1):
        if n > 1:
            g = K.extend(g, h, n)
        if n in lengths and n < WINDOW:
            at = _in_screen(screen, g)
            at = at[at + n <= doc_end[at]]
            out.append((at, np.full(len(at), n, np.int32), g[at], g[at]))
        if n == GRAM and WINDOW in lengths:
            kept = least(g, WINDOW - GRAM + 1)
            at = _in_screen(screen, kept)
            at = at[at + WINDOW <= doc_end[at]]
            whole = h[at]
            for k in range(1, WINDOW):
                whole = K.mix(whole * K.STEP + h[at + k])
            out.append((at, np.full(len(at), WINDOW, np.int32), kept[at], whole))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    at, n, kept, whole = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(at, kind="stable")
    return at[order], n[order], kept[order], whole[order]


def _scan(batches, screen: np.ndarray, lengths: list[int]):
    for b in batches:
        many, words, parts = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], []
        for _, _, h, bounds in _words(b.column(2)):
            at, n, kept, whole = candidates(screen, lengths, h, bounds)
            doc = np.searchsorted(bounds, at, "right") - 1
            parts.append((n, K.signed(kept), K.signed(whole), (at - bounds[doc]).astype(np.int32)))
            many.append(np.bincount(doc, minlength=len(bounds) - 1))
            words.append(np.diff(bounds))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int32)]
        struct = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "kept", "window", "start"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(many)).astype(np.int32)), struct)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(words), pa.int64()), lists], ["row_key", "doc_id", "n_words", "candidates"])


def _small(windows: DataFrame, limit: int) -> DataFrame:
    """The windows as the smaller side of a join: sent to all tasks only if they come to at most limit bytes."""
    size = F.expr("aggregate(items, 48L, (a, x) -> a + 16 + octet_length(x))")
    total = windows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(windows) if total <= limit else windows.hint("merge")


def decontaminate(documents: DataFrame, benchmark: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """documents' doc_id with n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = benchmark_windows(benchmark)
    screen, lengths = screen_of(windows)
    keyed = documents.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    scanned = written(keyed.mapInArrow(lambda b: _scan(b, screen, lengths), f"row_key long, doc_id {kind}, n_words long, candidates {CANDIDATES}"), "decontaminate")
    hits = scanned.where(F.size("candidates") > 0).select("row_key", F.inline("candidates")).join(_small(windows, small), ["n", "kept", "window"])
    met = hits.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Runs come by start: each adds what lies beyond the words covered so far.
    step = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(r["start"] + r["n"] - F.greatest(r["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], r["start"] + r["n"]).alias("end")
    )
    covered = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])
    facts = written(met.select("row_key", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "decontaminate")
    rows = scanned.drop("candidates").join(beside(facts, 100_000), "row_key", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return rows.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((hit > 0) & (RULE * hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns. A verdict follows from the text alone, so they are
    left out by a digest of it."""
    digest = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    bad = decontaminate(documents.select(digest.alias("doc_id"), "text"), benchmark, small).where("contaminated")
    bad = written(bad.select(F.col("doc_id").alias("__digest")).distinct(), "decontaminate")
    return documents.withColumn("__digest", digest).join(beside(bad), "__digest", "left_anti").select(documents.columns)
