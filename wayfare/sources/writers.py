"""Location traces written in the layouts that readers.py reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.sources.readers import FORMATS, Format


def _fields(form: Format) -> list[Column]:
    """The fields of a line, in order; those that the reader doesn't look at are 0."""
    stamp = F.timestamp_seconds("time")
    when = F.col("time").cast("long").cast("string") if form.layout is None else F.date_format(stamp, form.layout)
    at: dict[int, Column] = {form.lat: F.col("lat").cast("string"), form.lon: F.col("lon").cast("string")}
    if isinstance(form.time, tuple):
        day, clock = form.layout.split(" ")
        at |= {form.time[0]: F.date_format(stamp, day), form.time[1]: F.date_format(stamp, clock)}
    else:
        at[form.time] = when
    if isinstance(form.node, int):
        at[form.node] = F.col("node").cast("string")
    if form.alt is not None:
        at[form.alt] = F.col("alt").cast("string")
    return [at.get(i, F.lit("0")).alias(f"f{i}") for i in range(max(at) + 1)]


def write_traces(rows: DataFrame, kind: str, path: str) -> None:
    """Writes rows (node, time in whole seconds as UTC, lat, lon, alt as decimals, nth) below path in a trace format.

    Rows of a node stand in one file, in order of time and nth. Where files are told apart by node, a folder is made for each:
    its number, after new_ where the format wants that. The session's zone must be UTC for formats with dates. Japan's cells
    (kind japan) take x, y, d and t instead of lat, lon and time.
    """
    if kind == "japan":
        rows.repartition("node").sortWithinPartitions("node", "d", "t", "nth").select(F.col("node").alias("uid"), "d", "t", "x", "y").write.option("header", True).csv(path)
        return
    form = FORMATS[kind]
    if form.glob not in ("*.txt", "*.csv", "*.gz"):
        raise ValueError(f"{kind} files have an extension that Spark's writers don't give")
    by_file = form.node == "" or isinstance(form.node, str)
    dealt = rows.withColumn("key", F.concat(F.lit("new_" if form.node else ""), F.col("node").cast("string"))) if by_file else rows.withColumn("key", F.col("node"))
    dealt = dealt.repartition("node").sortWithinPartitions("key", "time", "nth")
    fields = _fields(form)
    if form.glob == "*.csv" and not form.squeeze:
        dealt.select(*fields).write.option("header", bool(form.skip)).csv(path)
        return
    text = dealt.select("key", F.concat_ws(" " if form.squeeze else form.sep, *fields).alias("value"))
    if by_file:
        text.write.partitionBy("key").text(path)
    elif form.glob == "*.gz":
        text.select("value").write.option("compression", "gzip").text(path)
    else:
        # Text files by the CSV writer, for their extension: one field, never quoted.
        text.select("value").write.option("quote", "").option("sep", "\u0001").csv(path)
