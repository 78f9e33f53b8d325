"""Dominance counts: for each row, how many rows lie at or before its slot and strictly above its level.

A square-root decomposition swept by slot. Equal (slot, level) pairs are summed up to cells first, so a hot pair is one cell.
Levels are cut into strips of STRIP whole numbers, a strip into blocks of BLOCK: a sweep keeps, for every level of a strip,
the sum of the levels above it in its block, and for every block the sum of the blocks above it, so that a query is one
addition and an update touches one block and the list of blocks. The cells of a strip, in order of slot, are cut into parts
of about PART cells; a part starts from the block arrays of all parts before it, which a scan accumulates block by block.
What lies in higher strips is the same question with strips for levels, and is answered by the same sweep, until one strip is
left (at most six times, for whole numbers of 64 bits). Nothing that grows with the rows meets in one task: a sweep streams its
sorted part and keeps one strip's arrays, a block's scan reads at most BUCKETS parts of BLOCK levels, and the driver gets
BUCKETS - 1 quantiles of slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import persisted

#: Levels of a strip and of a block, as powers of two: 64 blocks of 64 levels.
STRIP_BITS, BLOCK_BITS = 12, 6
STRIP, BLOCK = 1 << STRIP_BITS, 1 << BLOCK_BITS
#: Cells of a part, about, and buckets of slots from which parts are made: a strip has at most BUCKETS parts.
PART, BUCKETS = 32_768, 1024

_SWEPT = "slot long, level long, n long, w long"


def slot_of(df: DataFrame, time: str, width: int = 3600) -> Column:
    """Whole seconds since 1970 // width, the time taken as UTC in any session zone: a timestamp without a zone is read by its
    fields, one with a zone is an instant."""
    if dict(df.dtypes)[time] == "timestamp_ntz":
        day = F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        seconds = day * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    else:
        seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    return ((seconds - F.pmod(seconds, F.lit(width))) / width).cast("long")


def level_of(value: Column) -> Column:
    """Whole units of a value that is first rounded to hundredths (halves up), in doubles. What is no number has no level."""
    value = value.cast("double")
    rounded = F.floor(F.floor(value * 100 + 0.5).cast("double") / 100).cast("long")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), rounded)


def counts(points: DataFrame) -> DataFrame:
    """Of points (slot long, level long, weight long): per distinct (slot, level) the points above it, n, and their weights, w.

    A point is above a cell if its slot is at most the cell's and its level strictly larger. Points with a null slot or level
    are above none and get no row.
    """
    cells = points.where(F.col("slot").isNotNull() & F.col("level").isNotNull()).groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return _above(persisted(cells, "cells"))


def _above(cells: DataFrame) -> DataFrame:
    """counts() of distinct cells (slot, level, n, w) that are stored."""
    strip = F.shiftright("level", STRIP_BITS)
    at = [i / BUCKETS for i in range(1, BUCKETS)]
    facts = cells.agg(F.percentile_approx("slot", at, 10 * BUCKETS).alias("at"), F.min(strip).alias("low"), F.max(strip).alias("high"), F.count("*").alias("n")).first()
    if not facts.n:
        return cells
    n_buckets = min(BUCKETS, -(-facts.n // PART))
    bounds = np.array(sorted(set(facts["at"][BUCKETS // n_buckets - 1 :: BUCKETS // n_buckets])), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(slot: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, slot.to_numpy(), side="left"))

    cut = cells.withColumns({"strip": strip, "bucket": bucket("slot")})
    before = Window.partitionBy("strip").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tally = cut.groupBy("strip", "bucket").agg(F.count("*").alias("cells"))
    parts = tally.withColumn("part", F.coalesce((F.sum("cells").over(before) / PART).cast("long"), F.lit(0)))
    parts = parts.withColumn("part", (F.dense_rank().over(Window.partitionBy("strip").orderBy("part")) - 1).cast("long"))
    parts = parts.select("strip", "bucket", "part", F.max("part").over(Window.partitionBy("strip")).alias("last"))
    placed = persisted(cut.join(parts, ["strip", "bucket"]).drop("bucket"), "placed")
    swept = _sweep(placed, _starts(placed))
    if facts.low == facts.high:
        return swept.drop("strip")
    wide = placed.groupBy("slot", (F.col("strip") - facts.low).alias("level")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    higher = _above(persisted(wide, "strips")).select("slot", (F.col("level") + facts.low).alias("strip"), F.col("n").alias("more_n"), F.col("w").alias("more_w"))
    return swept.join(higher, ["slot", "strip"]).select("slot", "level", (F.col("n") + F.col("more_n")).alias("n"), (F.col("w") + F.col("more_w")).alias("w"))


def _starts(placed: DataFrame) -> DataFrame:
    """(strip, part, block, ns, ws): sums of each level of a block over all parts before; a part that starts from nothing has
    no row. One group scans the parts of one block."""
    block = F.shiftright(F.col("level").bitwiseAND(STRIP - 1), BLOCK_BITS)
    place = F.col("level").bitwiseAND(BLOCK - 1)
    sums = placed.where("last > 0").groupBy("strip", "last", block.alias("block"), "part", place.alias("place")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))

    def scan(rows: pa.Table) -> pa.Table:
        part, place, n, w, last = (rows[c].to_numpy() for c in ("part", "place", "n", "w", "last"))
        own = np.zeros((int(last[0]) + 1, BLOCK, 2), dtype=np.int64)
        own[part, place] = np.column_stack([n, w])
        start = np.cumsum(own, axis=0)[:-1]
        some = np.flatnonzero(start[:, :, 0].any(axis=1))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BLOCK), pa.array(start[some, :, k].ravel())) for k in (0, 1)]
        block = pa.array(np.full(len(some), rows["block"][0].as_py(), dtype=np.int32))
        return pa.table({"strip": pa.array(np.full(len(some), rows["strip"][0].as_py())), "part": pa.array(some + 1), "block": block, "ns": lists[0], "ws": lists[1]})

    return sums.groupBy("strip", "block").applyInArrow(scan, "strip long, part long, block int, ns array<long>, ws array<long>")


class _Strip:
    """Sums of the levels of one strip, kept so that a query is the sum of two entries."""

    def __init__(self) -> None:
        #: Of blocks: sums of the blocks above. Of levels: sums of the levels above in their block.
        self.blocks = np.zeros((BLOCK, 2), dtype=np.int64)
        self.levels = np.zeros((BLOCK, BLOCK, 2), dtype=np.int64)

    def add(self, level: np.ndarray, weights: np.ndarray) -> None:
        """Weights (n, w) at distinct levels."""
        block, place = level >> BLOCK_BITS, level & (BLOCK - 1)
        touched, row = np.unique(block, return_inverse=True)
        new = np.zeros((len(touched), BLOCK, 2), dtype=np.int64)
        new[row, place] = weights
        sums = np.flip(np.cumsum(np.flip(new, 1), axis=1), 1)
        self.levels[touched] += sums - new
        whole = np.zeros((BLOCK, 2), dtype=np.int64)
        whole[touched] = sums[:, 0]
        self.blocks += np.flip(np.cumsum(np.flip(whole, 0), axis=0), 0) - whole

    def above(self, level: np.ndarray) -> np.ndarray:
        block, place = level >> BLOCK_BITS, level & (BLOCK - 1)
        return self.blocks[block] + self.levels[block, place]


def _sweep(placed: DataFrame, starts: DataFrame) -> DataFrame:
    """(strip, slot, level, n, w) within strips: every part, streamed in order of slot, its start first."""
    none = lambda kind: F.lit(None).cast(kind)
    cells = placed.select("strip", "part", "slot", "level", "n", "w", none("int").alias("block"), none("array<long>").alias("ns"), none("array<long>").alias("ws"))
    heads = starts.select("strip", "part", none("long").alias("slot"), none("long").alias("level"), none("long").alias("n"), none("long").alias("w"), "block", "ns", "ws")
    dealt = cells.unionByName(heads).repartition("strip", "part").sortWithinPartitions("strip", "part", F.col("slot").asc_nulls_first())

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, held = None, _Strip(), None
        schema = pa.schema([(c, pa.int64()) for c in ("strip", "slot", "level", "n", "w")])

        def ended(rows: np.ndarray) -> list[np.ndarray]:
            """Answers of the whole slots in rows (part's slot, level, n, w): updates of a slot come before its queries."""
            out = []
            for one in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []:
                level = one[:, 1] & (STRIP - 1)
                sums.add(level, one[:, 2:])
                out.append(np.column_stack([np.full(len(one), at[0]), one[:, :2], sums.above(level)]))
            return out

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found).T], schema=schema)

        for batch in batches:
            keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            found: list[np.ndarray] = []
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else []
            for i, j in zip(edges, edges[1:], strict=False):
                if at != tuple(keys[i]):
                    if held is not None:
                        found += ended(held)
                    at, sums, held = tuple(keys[i]), _Strip(), None
                own = batch.slice(i, j - i)
                n_heads = own.column(2).null_count
                for k in range(n_heads):
                    base = own.column(6)[k].as_py() << BLOCK_BITS
                    weights = np.column_stack([own.column(7)[k].values.to_numpy(), own.column(8)[k].values.to_numpy()])
                    sums.add(base + np.arange(BLOCK), weights)
                rows = np.column_stack([own.column(c).slice(n_heads).to_numpy() for c in (2, 3, 4, 5)])
                rows = rows if held is None else np.concatenate([held, rows])
                if len(rows):  # the last slot may go on in the next batch
                    cut = int(np.searchsorted(rows[:, 0], rows[-1, 0], side="left"))
                    found += ended(rows[:cut])
                    held = rows[cut:]
            if found:
                yield batch_of(found)
        if held is not None and (found := ended(held)):
            yield batch_of(found)

    return dealt.mapInArrow(swept, "strip long, " + _SWEPT)


def sales_above(sales: DataFrame) -> DataFrame:
    """One row per sale: sale_id, slot, level, n_sales, n_rows.

    A sale stands for one row, or two if the crc32 of its id's decimal digits is odd; a null id has no digits and stands for
    one. A null (or non-finite) total has no level, a null sold_at no slot: such sales are above none and their counts are
    null. Repeated rows are sales of their own; sales of equal slot and level get equal counts. An empty table gives no rows;
    other columns, whatever their names, are no input.
    """
    weight = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 2
    read = sales.select("sale_id", slot_of(sales, "sold_at").alias("slot"), level_of(F.col("total")).alias("level"), weight.cast("long").alias("weight"))
    found = counts(read.drop("sale_id")).select("slot", "level", F.col("n").alias("n_sales"), F.col("w").alias("n_rows"))
    return read.drop("weight").join(found, ["slot", "level"], "left").select("sale_id", "slot", "level", "n_sales", "n_rows")
