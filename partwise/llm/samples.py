"""Bounded samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_LABEL, SAMPLE_BYTES = 1500, 48 << 20


def _training(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id and label (y) of all labelled rows outside the held-out fold."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    return ids.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds != held_out)


def label_counts(labels: DataFrame, label: str, folds: int, held_out: int) -> tuple[int, int]:
    """How many of all labelled rows outside the held-out fold are 0, and 1."""
    n = dict(_training(labels, label, folds, held_out).groupBy("y").count().collect())
    return n.get(0, 0), n.get(1, 0)


def labelled(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = ROWS_PER_LABEL, size: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most rows rows of each label, and of at most about size bytes in all.

    Rows whose crc32(doc_id as text) mod folds is held_out are never read; the others are taken in the order of another hash
    of doc_id, so the sample is the same in every run. Rows with a null doc_id, text or label are left out. Where ids repeat,
    no more than 4 * rows rows are read: the sample is bounded whatever the table holds.
    """
    ids = _training(labels, label, folds, held_out)
    chance = F.xxhash64("doc_id", F.lit(label))
    picked = ids.where("y = 1").orderBy(chance, "doc_id").limit(rows).unionByName(ids.where("y = 0").orderBy(chance, "doc_id").limit(rows))
    # The sample's ids are bounded by 2 * rows, so their side may be broadcast.
    found = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    order = F.xxhash64("doc_id", F.lit(label))
    out, used = [], 0
    for text, y in found.orderBy(order, "doc_id", "text").limit(4 * rows).select("text", "y").toLocalIterator():
        out.append((text, y))
        used += len(text)
        if used > size:
            break
    return out


def folded(documents: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, held_out and text."""
    key = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    return documents.select("doc_id", (key % folds == held_out).alias("held_out"), "text")
