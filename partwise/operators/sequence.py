"""Reordering in closed form: where each event of a partition's entity leaves a reorder buffer without time-outs.

Input: p, entity, seq, off. All windows are by (p, entity) or finer, so one shuffle by these serves them all, also where the
input comes dealt by p alone. Running sums over a partition go by blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SPAN, block, carried, inside

FAR = 9_999_999_999


def dispositions(s: DataFrame) -> DataFrame:
    """Adds anchor, rel (offset at which it is released, if without flush) and disposition: BELOW_ANCHOR, AFTER_RELEASE,
    IN_ORDER, REPLACED, FLUSHED or BUFFERED."""
    entity = Window.partitionBy("p", "entity")
    same = Window.partitionBy("p", "entity", "seq")
    a = s.repartition("p", "entity").withColumns(
        {
            "anchor": F.first("seq").over(entity.orderBy("off")),
            "occ": F.row_number().over(same.orderBy("off")),
            "next_off": F.lead("off").over(same.orderBy("off")),
        }
    )
    # Only first occurrences at or above the anchor advance the sequence; others are null in these frames.
    first = (F.col("occ") == 1) & (F.col("seq") >= F.col("anchor"))
    run = entity.orderBy("seq", "occ").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumns({"latest": F.max(F.when(first, F.col("off"))).over(run), "rank": F.count(F.when(first, 1)).over(run)})
    rel = F.when((F.col("seq") >= F.col("anchor")) & (F.col("seq") - F.col("anchor") + 1 == F.col("rank")), F.col("latest"))
    a = a.withColumn("rel", rel)
    d = (
        F.when(F.col("seq") < F.col("anchor"), "BELOW_ANCHOR")
        .when(F.col("rel").isNotNull() & (F.col("off") > F.col("rel")), "AFTER_RELEASE")
        .when(F.col("rel") == F.col("off"), "IN_ORDER")
        .when(F.col("next_off") < F.coalesce("rel", F.lit(FAR)), "REPLACED")
        .when(F.col("rel").isNull(), "FLUSHED")
        .otherwise("BUFFERED")
    )
    return a.withColumn("disposition", d).drop("occ", "next_off", "latest", "rank")


def anchors(s: DataFrame) -> DataFrame:
    """The first sequence number seen of each entity, which is accepted whatever it is."""
    return s.groupBy("p", "entity").agg(F.min_by("seq", "off").alias("anchor"))


def flush_order(s: DataFrame) -> DataFrame:
    """What is left in the buffers at the end, in the order of its release: by entity, then by sequence number."""
    left = dispositions(s).where("disposition = 'FLUSHED'")
    place = Window.partitionBy("p", "entity").orderBy("seq")
    return left.select("p", "entity", "seq", "off", F.row_number().over(place).cast("long").alias("place"))


def gaps(s: DataFrame) -> DataFrame:
    """Missing ranges of sequence numbers of each entity, from its anchor on."""
    seen = dispositions(s).where("disposition <> 'BELOW_ANCHOR'").select("p", "entity", "seq").distinct()
    before = F.lag("seq").over(Window.partitionBy("p", "entity").orderBy("seq"))
    return seen.withColumn("before", before).where("seq - before > 1").select("p", "entity", (F.col("before") + 1).alias("missing_from"), (F.col("seq") - 1).alias("missing_to"))


def depth(s: DataFrame, span: int = SPAN) -> DataFrame:
    """The number of buffered events of each partition after each offset: +1 when one is buffered, -1 when it is released."""
    d = dispositions(s)
    moved = F.when(F.col("disposition") == "BUFFERED", F.array(F.struct(F.col("off").alias("at"), F.lit(1).alias("d")), F.struct(F.col("rel").alias("at"), F.lit(-1).alias("d"))))
    kept = F.when(F.col("disposition") == "FLUSHED", F.array(F.struct(F.col("off").alias("at"), F.lit(1).alias("d"))))
    steps = d.select("p", F.explode(F.coalesce(moved, kept, F.array(F.struct(F.col("off").alias("at"), F.lit(0).alias("d"))))).alias("x"))
    net = steps.groupBy("p", F.col("x.at").alias("off")).agg(F.sum("x.d").alias("d")).withColumn("__block", block(span))
    net = carried(net, F.sum("d"), F.sum, "__carry")
    total = F.sum("d").over(inside().rowsBetween(Window.unboundedPreceding, 0))
    return net.select("p", "off", (total + F.coalesce("__carry", F.lit(0))).alias("depth"))


def backpressure(s: DataFrame, most: int, resume: float = 0.8, span: int = SPAN) -> DataFrame:
    """Offsets at which a partition's buffer turns backpressure on (at most or more) or off (below int(most * resume))."""
    low = int(most * resume)
    want = F.when(F.col("depth") >= most, 1).when(F.col("depth") < low, 0)
    d = depth(s, span).withColumns({"want": want, "__block": block(span)})
    d = carried(d, F.max_by("want", F.when(F.col("want").isNotNull(), F.col("off"))), lambda c: F.last(c, True), "__carry")
    start = F.coalesce("__carry", F.lit(0))
    d = d.withColumn("active", F.coalesce(F.last("want", True).over(inside().rowsBetween(Window.unboundedPreceding, 0)), start))
    return d.withColumn("was", F.coalesce(F.lag("active").over(inside()), start)).where("active <> was").select("p", "off", "depth", (F.col("active") == 1).alias("active"))


def stages(d: DataFrame, unreadable) -> DataFrame:
    """Adds stage, the last one that an event came to; d: dispositions with duplicate; unreadable: what no parser takes."""
    late = F.when(F.col("duplicate"), "DEDUPLICATION").otherwise("REORDER")
    stage = F.when(unreadable, "DESERIALIZE").when(F.col("disposition").isin("BELOW_ANCHOR", "AFTER_RELEASE"), late).when(F.col("disposition") == "REPLACED", "REORDER")
    return d.withColumn("stage", stage.otherwise("BUSINESS_LOGIC"))
