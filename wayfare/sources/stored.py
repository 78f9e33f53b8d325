"""Relations that are changed by key, and deletion of a dataset with all that hangs on it.

A relation is a folder of data files, never rewritten in place, and of manifests: version n is the list of files that make it
up, a small table whose _SUCCESS mark publishes it. Readers take the last published one, so a writer that fails half-way leaves
the version before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources.sinks import checkpointed, children, exists, remove


def _latest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last published version and its files; 0 and none of a relation that does not exist."""
    published = [int(n) for n in children(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{n}/_SUCCESS")]
    if not published:
        return 0, []
    last = max(published)
    return last, sorted(r.file for r in spark.read.parquet(f"{path}/manifest/{last:09d}").collect())


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The relation as last published."""
    version, files = _latest(spark, f"{root}/{name}")
    if not version:
        raise ValueError(f"{name} is not stored in {root}")
    return spark.read.parquet(*files)


def merge(updates: DataFrame, root: str, name: str, keys: list[str], order: Column | None = None) -> int:
    """Upserts by key and publishes; the new version's number.

    Rows of updates replace the stored rows of their keys, other rows are added. Of several updates of a key the greatest by
    order counts (of equal ones, or without order, the greatest by all columns). Only files that hold a key of updates are
    read whole and written anew, without these keys; they are found by the key columns alone. Nothing but names of files comes
    to the driver. A null key equals nothing: such rows are added. Without updates no version is published.
    """
    spark, path = updates.sparkSession, f"{root}/{name}"
    rank = F.struct(*([order.alias("_order")] if order is not None else []), *[F.col(c).alias(f"_{c}") for c in sorted(updates.columns)])
    known = updates.where(" and ".join(f"`{k}` is not null" for k in keys))
    one = known.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), rank).alias("_row")).select("_row.*").select(*updates.columns)
    new = checkpointed(one.unionByName(updates.where(" or ".join(f"`{k}` is null" for k in keys))))
    if new.isEmpty():
        return _latest(spark, path)[0]
    version, files = _latest(spark, path)
    rows, touched = new, set()
    if files:
        held = spark.read.parquet(*files).select(*keys, F.col("_metadata.file_path").alias("_file"))
        touched = {r["_file"] for r in held.join(new.select(*keys), keys, "left_semi").select("_file").distinct().collect()}
        if touched:
            rows = spark.read.parquet(*sorted(touched)).join(new.select(*keys), keys, "left_anti").unionByName(new)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows.repartitionByRange(*keys).write.parquet(folder)
    made = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file")).distinct()
    kept = spark.createDataFrame([(f,) for f in files if f not in touched], "file string")
    kept.unionByName(made).coalesce(1).write.parquet(f"{path}/manifest/{version + 1:09d}")
    return version + 1


def delete_dataset(spark: SparkSession, root: str, dataset: str) -> list[str]:
    """Removes a dataset, its experiments, and every stored relation's partitions of either: the paths that went.

    Relations are the folders below root; a partition is of the dataset if its column is dataset_name (dataset or
    family_dataset), and of an experiment of it if its column is experiment_name. Experiments are those that the relations
    experiments and experiment_families name; names of experiments come to the driver, rows never.
    """
    names: set[str] = set()
    for relation, column in (("experiments", "dataset_name"), ("experiment_families", "family_dataset")):
        if any("=" in p for p in children(spark, f"{root}/{relation}")):
            found = spark.read.parquet(f"{root}/{relation}").where(F.col(column) == dataset).select("experiment_name").distinct()
            names |= {r[0] for r in found.collect()}
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    doomed = {f"{c}={escaped(dataset)}" for c in ("dataset_name", "dataset", "family_dataset")} | {f"experiment_name={escaped(n)}" for n in names}
    # Experiments name the others, so they go last: a run that fails half-way can be repeated.
    relations = sorted(children(spark, root), key=lambda x: (x.startswith("experiment"), x))
    gone = [f"{root}/{r}/{p}" for r in relations for p in children(spark, f"{root}/{r}") if p in doomed]
    for path in gone:
        remove(spark, path)
    return gone
