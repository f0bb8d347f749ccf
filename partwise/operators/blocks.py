"""Long sequences in blocks of their order: what one window over a whole partition would gather in one task is dealt out by
(p, block), and what a block needs of those before it comes as a halo of rows or as one carried value a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024


def block(span: int = SPAN) -> Column:
    return F.floor(F.col("off") / span).cast("long")


def with_halo(s: DataFrame, window: int, span: int = SPAN) -> DataFrame:
    """s dealt out by (p, __block); each block has the rows of the window offsets before it too, marked __halo."""
    if window > span:
        raise ValueError("a window is not longer than a block")
    near = F.pmod("off", F.lit(span)) >= span - window
    copies = F.when(near, F.array(block(span), block(span) + 1)).otherwise(F.array(block(span)))
    return s.withColumn("__block", F.explode(copies)).withColumn("__halo", F.col("__block") != block(span)).repartition("p", "__block")


def inside(ordered: bool = True):
    w = Window.partitionBy("p", "__block")
    return w.orderBy("off") if ordered else w


def carried(df: DataFrame, last: Column, over, name: str) -> DataFrame:
    """df (with __block) with name: over, an aggregate of the earlier blocks' values of last, one a block; null before the first."""
    each = df.groupBy("p", "__block").agg(last.alias("__last"))
    before = Window.partitionBy("p").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(each.select("p", "__block", over(F.col("__last")).over(before).alias(name)), ["p", "__block"])
