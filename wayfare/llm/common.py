"""Reading tables, cutting lineage, and small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts of an Arrow batch that are Python strings at one time.
SLICE = 256
#: Rows of an Arrow batch at most, for rows that hold whole texts; Spark's own bound is 10,000.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. Where it is unset, a local session gets a
    folder of its own; on a cluster no folder of one machine would do, and an error is raised."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='wayfare-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def persisted(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled_rows(docs: DataFrame, known: DataFrame, rows: int, size: int) -> DataFrame | None:
    """(doc_id, text, label) of docs (doc_id, text) that known (doc_id, label, one row an id) names, at most `rows` rows and
    `size` bytes of text, the first by hash of doc_id. Of an id with several texts the least is taken, null ones never. None if
    there is no such row."""
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    found = persisted(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumns({"turn": F.xxhash64("doc_id"), "size": F.octet_length("text")}), "sample")
    lengths = sorted(tuple(r) for r in found.select("turn", "doc_id", "size").collect())
    total, last = 0, None
    for turn, doc_id, n in lengths:
        total += n
        if total > size:
            break
        last = turn, doc_id
    if last is None:
        return None
    within = (F.col("turn") < last[0]) | (F.col("turn") == last[0]) & (F.col("doc_id") <= last[1])
    return found.where(within).select("doc_id", "text", "label")


class Trained:
    """A model as the bytes that a task has pickled. Where it is sent to workers, the model itself arrives; the driver makes it only
    when an attribute of it is asked for."""

    def __init__(self, data: bytes):
        self._data, self._model = data, None

    def __reduce__(self):
        return pickle.loads, (self._data,)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if self._model is None:
            self._model = pickle.loads(self._data)
        return getattr(self._model, name)


#: Bytes of a pickled model in one row.
PIECE = 4 << 20


def trained(sample: DataFrame | None, train: Callable[[list[tuple]], object]) -> Trained:
    """train() of the sorted rows of a sample, which is bounded, in one task: neither the texts nor what training needs stands in
    the driver, which gets the pickled model."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        data = pickle.dumps(train(rows), protocol=pickle.HIGHEST_PROTOCOL) if rows else b""
        del rows
        release()
        for i in range(0, len(data), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data[i : i + PIECE]], type=pa.binary())], ["at", "piece"])

    pieces = sorted((tuple(r) for r in in_small_batches(sample).coalesce(1).mapInArrow(fitted, "at long, piece binary").collect()), key=lambda r: r[0]) if sample is not None else []
    model = Trained(b"".join(p for _, p in pieces) or pickle.dumps(train([])))
    del pieces
    release()
    return model


def release() -> None:
    """Gives memory back that this worker's earlier tasks have freed: workers live on from stage to stage, and what one stage's
    model took would stay with the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_ROWS rows: they stand in the JVM and in a worker twice each. This
    is a setting of the session, read when a plan runs, and stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def spare(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def one_blas_thread() -> Iterator[None]:
    """numpy's OpenBLAS uses one thread inside: its thread pool can block in a driver that has forked, and small matrices don't need it."""
    found = None
    for lib in Path(np.__file__).parent.with_name("numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(lib))
        found = next(((getattr(lib, f"{p}openblas_get_num_threads{s}"), getattr(lib, f"{p}openblas_set_num_threads{s}")) for p in ("scipy_", "") for s in ("64_", "") if hasattr(lib, f"{p}openblas_set_num_threads{s}")), None)
    before = found[0]() if found else 1
    if found:
        found[1](1)
    try:
        yield
    finally:
        if found:
            found[1](before)
