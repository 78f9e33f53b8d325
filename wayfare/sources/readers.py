"""Readers of location traces into events (dataset_name, time, node, x, y, z), and of message files.

Every reader names its columns and types, keeps the first of rows that share a node and a time, and drops rows that it
cannot read. Files are found recursively by extension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import geo
from wayfare.functions.ranks import numbered_keys
from wayfare.sources.sinks import checkpointed

EVENT = ["dataset_name", "time", "node", "x", "y", "z"]


@dataclass(frozen=True)
class Format:
    """Fields of a line by ordinal; what isn't given is absent. node: an ordinal, or a pattern on the path."""

    glob: str
    lat: int
    lon: int
    time: int | tuple[int, int]
    node: int | str
    alt: int | None = None
    sep: str = ","
    layout: str | None = "yyyy-MM-dd HH:mm:ss"  # None: epoch seconds
    flat: bool = False
    skip: int = 0
    squeeze: bool = False


#: Layouts of the formats (fixed values).
FORMATS = {
    "tdrive": Format("*.txt", 3, 2, 1, ""),
    "cabspotting": Format("*.txt", 0, 1, 3, r"new_([a-zA-Z0-9]+)", sep=" ", layout=None),
    "cabspotting2d": Format("*.txt", 0, 1, 3, r"new_([a-zA-Z0-9]+)", sep=" ", layout=None, flat=True),
    "hand": Format("*.txt", 0, 1, 3, r"new_([a-zA-Z0-9]+)", sep=" ", layout=None),
    "geolife": Format("*.plt", 0, 1, (5, 6), r"Data/([0-9]+)/", alt=3, skip=6),
    "geolife2d": Format("*.plt", 0, 1, (5, 6), r"Data/([0-9]+)/", alt=3, skip=6, flat=True),
    "hamburg": Format("*.csv", 2, 3, 4, 1),
    "napa": Format("*.csv", 2, 3, 4, 1, skip=1),
    "kalmaegi": Format("*.csv", 2, 3, 4, 1),
    "wipha": Format("*.csv", 2, 3, 4, 1),
    "rammasun": Format("*.csv", 2, 3, 4, 1),
    "halong": Format("*.csv", 2, 3, 4, 1),
    "mdc": Format("*.csv", 2, 3, 1, 0, alt=4, layout=None, squeeze=True),
    "randomwalk": Format("*.gz", 2, 3, 0, 1, layout=None),
}


def _first_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("path", "line")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def lines(spark: SparkSession, path: str, glob: str, value: Column | str = "value") -> DataFrame:
    """(path, line, value) of all lines of all files below path; line (split, then place in it) grows inside a file. value: what to
    make of a line's text. It is made beside the line's id, through which Spark pushes no condition, so once a line."""
    # Spark lists up to 10,000 folders by a task each; a folder a node makes that most of the time.
    conf, name = spark.conf, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = conf.get(name)
    conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    finally:
        conf.set(name, before)
    return read.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("line"), (F.col(value) if isinstance(value, str) else value).alias("value"))


def dense_ids(rows: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """rows with node: number of the key (file, device name) among all keys in their order. keys: rows with the same keys that are
    cheaper to read; they are read once."""
    held = checkpointed((rows if keys is None else keys).select(key).distinct())
    return rows.join(numbered_keys(held, key, checkpointed, "node"), key)


def read_delimited(spark: SparkSession, path: str, dataset: str, form: Format) -> DataFrame:
    value = F.trim(F.regexp_replace("value", r"\s+", " ")) if form.squeeze else F.col("value")
    rows = lines(spark, path, form.glob, F.split(value, "[, ]+" if form.squeeze else form.sep)).withColumnRenamed("value", "parts")
    if form.skip:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("nth") > form.skip).drop("nth")
    at = lambda i: F.trim(F.get(F.col("parts"), i))
    number = lambda i: at(i).try_cast("double")
    if form.layout is None:
        time = number(form.time)
    else:
        text = F.concat_ws(" ", at(form.time[0]), at(form.time[1])) if isinstance(form.time, tuple) else at(form.time)
        time = F.unix_timestamp(F.try_to_timestamp(text, F.lit(form.layout))).cast("double")
    alt: Column = F.lit(0.0) if form.alt is None else number(form.alt)
    if form.alt is not None and form.glob == "*.plt":
        alt = F.when(F.abs(F.lit(-777.0) - alt) < 1, F.lit(0.0)).otherwise(alt)
    key = F.col("path") if form.node == "" else F.nullif(F.regexp_extract("path", form.node, 1), F.lit("")) if isinstance(form.node, str) else F.nullif(at(form.node), F.lit(""))
    x, y, z = (*geo.mercator(F.col("lat"), F.col("lon")), F.lit(0.0)) if form.flat else geo.ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    read = rows.select("path", "line", key.alias("key"), time.alias("time"), number(form.lat).alias("lat"), number(form.lon).alias("lon"), alt.alias("alt")).where("key is not null and time is not null and lat is not null and lon is not null and alt is not null")
    if form.flat:
        read = read.where(y.isNotNull())  # the logarithm of a latitude beyond the poles; other places are never null
    by_name = form.node == "" or isinstance(form.node, str) or form.squeeze
    if by_name:
        read = checkpointed(read)  # keys and rows are both read from it: each file is opened once
    first = _first_wins(read, ["key", "time"])
    numbered = dense_ids(first, "key", read) if by_name else first.withColumn("node", F.col("key").try_cast("long")).where("node is not null")
    return numbered.select(F.lit(dataset).alias("dataset_name"), "time", "node", x.alias("x"), y.alias("y"), z.alias("z"))


def read_grid_days(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Cell traces uid, d, t, x, y with a header: 500 m cells, half hours since 2024-01-01."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True).schema("uid long, d long, t long, x double, y double").csv(path)
    rows = read.where("uid is not null and d is not null and t is not null").select((F.lit(1704067200.0) + F.col("d") * 86400 + F.col("t") * 1800).alias("time"), F.col("uid").alias("node"), (F.col("x") * 500).alias("x"), (F.col("y") * 500).alias("y"), F.lit(0.0).alias("z"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
    return _first_wins(rows, ["node", "time"]).select(F.lit(dataset).alias("dataset_name"), "time", "node", "x", "y", "z")


def read_positions_json(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """JSON arrays of {user, simtime, position{X, Y, Z}}, Cartesian already."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).schema("user long, simtime double, position struct<X:double,Y:double,Z:double>").json(path)
    rows = read.where("user is not null and simtime is not null").select(F.col("simtime").alias("time"), F.col("user").alias("node"), F.col("position.X").alias("x"), F.col("position.Y").alias("y"), F.col("position.Z").alias("z"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
    return _first_wins(rows, ["node", "time"]).select(F.lit(dataset).alias("dataset_name"), "time", "node", "x", "y", "z")


def import_traces(spark: SparkSession, kind: str, path: str, dataset: str) -> DataFrame:
    """Events of all files of a kind below path."""
    if kind == "japan":
        return read_grid_days(spark, path, dataset)
    if kind == "simple":
        return read_positions_json(spark, path, dataset)
    if kind not in FORMATS:
        raise ValueError(f"unknown trace format {kind!r}")
    return read_delimited(spark, path, dataset, FORMATS[kind])


MESSAGE_JSON = "map<string,array<struct<id:string,sender:bigint,type:int,destinationnode:bigint,payload:string,time:double,shards:int,shardid:int,ms:boolean,ttl_hops:int,ttl_time:bigint,ttl_secs:bigint,size:float>>>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON file {sender: [message, ...]}; ttl_secs stands for a missing ttl_time."""
    text = spark.read.option("wholetext", True).text(path)
    lists = text.select(F.explode(F.from_json("value", MESSAGE_JSON)).alias("node", "l")).select("node", F.explode("l").alias("m"))
    return lists.select("m.id", F.coalesce("m.sender", F.col("node").cast("long")).alias("sender"), "m.type", "m.destinationnode", F.col("m.destinationnode").cast("string").alias("destination"), "m.payload", "m.time", "m.shards", "m.shardid", "m.ms", "m.ttl_hops", F.coalesce("m.ttl_time", "m.ttl_secs").alias("ttl_time"), "m.size")


def read_template(text: str) -> list[dict]:
    """A message template: one JSON object, or an array of them."""
    import json

    found = json.loads(text)
    return found if isinstance(found, list) else [found]


def table(spark: SparkSession, root: str, name: str, dataset: str | None = None) -> DataFrame:
    """A stored relation, of one dataset by partition pruning."""
    df = spark.read.parquet(f"{root}/{name}")
    return df.where(F.col("dataset_name") == dataset) if dataset else df
