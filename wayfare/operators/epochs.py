"""The epoch grid and the positions between which a node moves in each epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clock(spark: SparkSession, start: float, end: float, step: float) -> DataFrame:
    """Ticks (i, t) from start by step up to end; i x step, so that no error adds up."""
    n = int((end - start) // step)
    return spark.range(n + 1).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * F.lit(float(step))).alias("t"))


def epochs(spark: SparkSession, start: float, end: float, step: float, drop_tail: bool = False) -> DataFrame:
    """Epochs (epoch, prev, now, next) between neighbouring ticks; drop_tail: without the last two, for parity."""
    n = int((end - start) // step) - (2 if drop_tail else 0)
    i = F.col("id")
    at = lambda k: F.lit(start) + (i + k) * F.lit(float(step))
    last = F.lit(start) + F.lit(float(int((end - start) // step)) * step)
    return spark.range(max(0, n)).select(i.alias("epoch"), at(0).alias("prev"), at(1).alias("now"), F.when(at(2) <= last, at(2)).alias("next"))


def segments(events: DataFrame, step: float, n_epochs: int, start: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """(by..., node, epoch, prev, now, start, end) of each active node and epoch; start, end: structs t, x, y, z.

    start is the last event at or before prev, end the first one at or after now; a node is active if its first event is
    before prev and its last after now. No join: every event is the start of the epochs that begin before the next event,
    and the next event, or the first of a later tick, is their end. One shuffle by node.
    """
    keys = [*(by or []), "node"]
    tick = lambda t, f: f((t - F.lit(start)) / F.lit(float(step))).cast("long")
    point = F.struct("t", "x", "y", "z")
    w = Window.partitionBy(*keys).orderBy("t")
    later = Window.partitionBy(*keys).orderBy(F.desc("slot")).rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    e = events.select(*keys, "t", "x", "y", "z").withColumn("slot", tick(F.col("t"), F.floor))
    # desc order: "preceding" rows have greater slots.
    e = e.withColumns({"point": point, "after": F.min(point).over(later), "first_t": F.min("t").over(whole), "last_t": F.max("t").over(whole)})
    e = e.withColumns({"nxt": F.lead("point").over(w), "nxt_after": F.lead("after").over(w)}).where(F.col("nxt").isNotNull() & (F.col("nxt.t") > F.col("t")))
    lo, hi = F.greatest(tick(F.col("t"), F.ceil), F.lit(0)), F.least(tick(F.col("nxt.t"), F.ceil) - 1, F.lit(n_epochs - 1))
    e = e.where(hi >= lo).withColumn("epoch", F.explode(F.sequence(lo, hi)))
    e = e.withColumns({"prev": F.lit(start) + F.col("epoch") * F.lit(float(step)), "now": F.lit(start) + (F.col("epoch") + 1) * F.lit(float(step))})
    e = e.withColumn("end", F.when(F.col("nxt.t") >= F.col("now"), F.col("nxt")).otherwise(F.col("nxt_after")))
    active = (F.col("first_t") < F.col("prev")) & (F.col("last_t") > F.col("now")) & F.col("end").isNotNull()
    return e.where(active).select(*keys, "epoch", "prev", "now", F.col("point").alias("start"), "end")
