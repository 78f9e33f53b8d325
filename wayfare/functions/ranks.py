"""Row numbers over a whole DataFrame without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, by: list[str], name: str = "nth", buckets: int = 64) -> DataFrame:
    """df with the number (from 0) of each row in the order of by, whose first column is numeric.

    Approximate quantiles of the first column cut the rows into buckets; rows are numbered inside them and moved by the
    counts of the buckets before. Only the quantiles reach the driver. df is evaluated three times: cut its lineage first.
    """
    at = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.agg(F.percentile_approx(F.col(by[0]).cast("double"), at, 1000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b <= F.col(by[0]).cast("double")))
    cut = df.withColumn("_bucket", F.coalesce(bucket, F.lit(0)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by)) - 1
    return cut.withColumn("_nth", inside).join(F.broadcast(starts), "_bucket").withColumn(name, (F.col("_first") + F.col("_nth")).cast("long")).drop("_bucket", "_nth", "_first")


def numbered_keys(keys: DataFrame, key: str | list[str], keep, name: str = "nth") -> DataFrame:
    """keys (of any type) with the number (from 0) of each in order: of equal ones all get the first one's. keep(df) stores a table.

    Keys are dealt by ranges, numbered inside them and moved by the counts of the ranges before: one row a range is all that
    meets in one task. Equal keys lie in one range.
    """
    by = [key] if isinstance(key, str) else key
    cut = keep(keys.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = F.rank().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return cut.withColumn("_nth", inside).join(starts, "_range").select(*keys.columns, (F.col("_first") + F.col("_nth")).cast("long").alias(name))
