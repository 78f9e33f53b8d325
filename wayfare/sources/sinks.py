"""Stored relations and exports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relations that clear() leaves alone.
KEPT = ("datasets", "events", "node_lists", "encounters", "dataset_encounter_enumerations")


def store(df: DataFrame, root: str, name: str, by: str) -> None:
    """Writes a relation partitioned by dataset or experiment; partitions that df has replace those stored (upsert by key)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/{name}")


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: floats with two decimals."""
    return df.select(*[(F.format_string("%.2f", F.col(c)) if t in ("float", "double") else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str) -> None:
    as_text(df).write.mode("overwrite").option("header", True).csv(path)


def messages_json(messages: DataFrame) -> DataFrame:
    """One row (sender, json) for each sender; json is the array of its messages."""
    m = F.struct(*[c for c in messages.columns])
    return messages.groupBy("sender").agg(F.to_json(F.array_sort(F.collect_list(m))).alias("json"))


def _at(spark: SparkSession, path: str) -> tuple:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none of one that does not exist."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def delete(spark: SparkSession, root: str, name: str, by: str, value: str) -> None:
    """Removes a dataset's or an experiment's partition of a relation."""
    remove(spark, f"{root}/{name}/{by}={value}")


def clear(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Removes relations but those in KEPT; their names."""
    gone = [n for n in names if n not in KEPT]
    for n in gone:
        remove(spark, f"{root}/{n}")
    return gone


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. Where it is unset, a local session gets a
    folder of its own, removed at its end; a cluster gets an error, as no folder of one machine would do."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="wayfare-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage: written once as Parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
