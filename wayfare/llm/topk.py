"""Exact top-k by inner product over norm-sorted blocks.

Vectors become integers. Candidates are range-partitioned and sorted by descending length, packed into blocks and stored; their
coordinates are rotated by the right singular vectors of a bounded sample, so that the first ones carry most of the
length. Every query starts with the k-th best score among the longest vectors as its threshold. A block of candidates is gone
through in strides by descending length: a query whose length times the stride's greatest length stays under its threshold
is done with the block. For the others, the partial sum over the leading rotated coordinates plus the product of the residual
lengths (Cauchy-Schwarz) bounds the score from above; only pairs whose bound reaches the threshold get their exact integer
product, and the k-th best of these raises the threshold for the next stride and the task's next block. Blocks meet by a cartesian
product of what is stored: neither side is copied for the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import one_blas_thread, persisted

#: Rows in a block; bytes of a block are BLOCK x dimensions x those of an integer.
BLOCK = 2048
#: Rows (by hash) that the rotation is fitted on, and long rows that give the first thresholds; classes of length to a doubling of the square.
SAMPLE, SEEDS, CLASSES = 4096, 2048, 64
#: Candidates of a block that are bounded at once; thresholds rise between.
STRIDE = 256
#: Share of the squared length that the leading coordinates must carry.
LEAD_SHARE = 0.8

_PACKED = "block long, ids binary, vecs binary"
#: Integers of a block: the first kind that holds all components.
_KINDS = {"smallint": np.int16, "int": np.int32, "bigint": np.int64}


def _ints(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _padded(rows: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of an Arrow list, shorter ones padded with zeros."""
    n, flat = np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy()
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), dtype=flat.dtype)
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _top(q: np.ndarray, c: np.ndarray) -> float:
    """No product of rows, and no part of one, is greater."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows, held to the range of a long."""
    top = _top(q, c)
    if top < 2**24:
        return (q.astype(np.float32) @ c.T.astype(np.float32)).astype(np.int64)
    if top < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def scan(queries: tuple, candidates: tuple, low: np.ndarray, k: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query that reach its threshold low: query positions, candidate ids, scores; and how many
    pairs were bounded and how many multiplied.

    queries and candidates: ids, integer vectors, leading rotated coordinates, lengths of the rest; candidates come by
    descending length. Where the leading coordinates are most of all and products are exact in short floats, bounds would cost more
    than the products.
    """
    (q_ids, q, qh, qr), (c_ids, c, ch, cr) = queries, candidates
    q_len, c_len = np.sqrt((qh**2).sum(axis=1) + qr**2), np.sqrt((ch**2).sum(axis=1) + cr**2)
    low = low.copy()
    slack = 1e-9 * q_len * c_len.max(initial=0.0) + 1e-6
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(q_ids)
    bounded = multiplied = 0
    direct = 2 * qh.shape[1] > q.shape[1] and _top(q, c) < 2**24
    short = (q.astype(np.float32), c.astype(np.float32)) if direct else None
    for start in range(0, len(c_ids), stride):
        part = slice(start, start + stride)
        live = np.flatnonzero(q_len * c_len[start:].max() >= low - slack)
        if not len(live):
            break
        full = short[0][live] @ short[1][part].T if direct else None
        able = full >= low[live, None].astype(np.float32) if direct else qh[live] @ ch[part].T + np.outer(qr[live], cr[part]) >= (low - slack)[live, None]
        able &= c_ids[part][None, :] != q_ids[live][:, None]
        bounded += able.size
        dense = direct or able.mean() > 0.25
        full = _product(q[live], c[part]) if dense and not direct else full
        multiplied += able.size if dense else int(able.sum())
        for j in np.flatnonzero(able.any(axis=1)):
            i, at = live[j], np.flatnonzero(able[j])
            scores = full[j, at].astype(np.int64) if dense else _product(q[i : i + 1], c[part][at])[0]
            ids, scores = np.append(held[i][0], c_ids[part][at]), np.append(held[i][1], scores)
            top = _best(ids, scores, k)
            held[i] = ids[top], scores[top]
            if len(top) == k:
                low[i] = max(low[i], float(scores[top[-1]]))
    who = np.repeat(np.arange(len(q_ids)), [len(h[0]) for h in held])
    ids, scores = (np.concatenate([np.zeros(0, dtype=np.int64), *[h[n] for h in held]]) for n in (0, 1))
    return who, ids, scores, np.array([bounded, multiplied])


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k best of each query (rows whose id is divisible by every) among all other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a null
    id, take no part; shorter vectors count as padded with zeros. Rows with the query's own id are no candidates for it.
    Repeated rows (equal id) are candidates one by one; a query id that repeats is one query, its vector the smallest.
    Fewer candidates than k: all are returned. Empty tables give no rows. Scores beyond a long are held to its range.
    """
    e = F.col(embedding)
    usable = F.col(vec_id).isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    n, dim, n_own, *limits = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("id") % every == 0), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    dim = max(1, dim or 1)
    kind = next(k for k, t in _KINDS.items() if all(np.iinfo(t).min <= (x or 0) <= np.iinfo(t).max for x in limits))
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sample, longest = _some(rows, n, SAMPLE)["v"], _longest(rows, SEEDS)
    seeds, seed_ids = _ints(longest["v"], dim), longest["id"].to_numpy(dtype=np.int64)
    with one_blas_thread():
        _, lengths, turn = np.linalg.svd(_ints(sample, dim).astype(np.float64) if len(sample) else np.eye(dim), full_matrices=True)
    share = np.cumsum(lengths**2) / max(float((lengths**2).sum()), 1e-300)
    lead = int(min(dim, max(1, np.searchsorted(share, LEAD_SHARE) + 1)))
    turn = np.ascontiguousarray(turn.T)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = np.zeros(0, dtype=np.int64), np.zeros((0, dim), dtype=_KINDS[kind])

        def out(ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[:1]), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, vecs)]], ["block", "ids", "vecs"])

        for batch in batches:
            ids, vecs = np.append(ids, batch["id"].to_numpy()), np.append(vecs, _padded(batch["v"], dim), axis=0)
            at = 0
            while len(ids) - at >= block:
                yield out(ids[at : at + block], vecs[at : at + block])
                at += block
            ids, vecs = ids[at:], vecs[at:]
        if len(ids):
            yield out(ids, vecs)

    def unpacked(ids: pa.Scalar, vecs: pa.Scalar) -> tuple:
        v = np.frombuffer(vecs.as_buffer(), dtype=_KINDS[kind]).reshape(-1, dim).astype(np.int64)
        turned = v.astype(np.float64) @ turn
        return np.frombuffer(ids.as_buffer(), dtype=np.int64), v, np.ascontiguousarray(turned[:, :lead]), np.sqrt((turned[:, lead:] ** 2).sum(axis=1))

    def floors(q_ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        scores = _product(q, seeds).astype(np.float64)
        scores[q_ids[:, None] == seed_ids[None, :]] = -np.inf
        return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(q_ids), -np.inf)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, low, best = None, None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (asked[0][best[0]], *best[1:])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                if at != (at := batch["q_block"][row].as_py()):
                    yield from out()
                    asked = unpacked(batch["q_ids"][row], batch["q_vecs"][row])
                    low, best = floors(*asked[:2]), None
                found = scan(asked, unpacked(batch["ids"][row], batch["vecs"][row]), low, k)[:3]
                best, low = _kept(found if best is None else [np.append(x, y) for x, y in zip(best, found, strict=True)], low, k)
        yield from out()

    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(lanes, F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id")).select("id", "v")
    candidates = persisted(ordered.mapInArrow(pack, _PACKED), "candidates").drop("block")
    own = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = persisted(own.coalesce(max(1, n_own // block)).mapInArrow(pack, _PACKED), "queries").withColumnsRenamed({c: f"q_{c}" for c in ("block", "ids", "vecs")})
    pairs = queries.hint("shuffle_replicate_nl").crossJoin(candidates).mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _some(rows: DataFrame, n: int, most: int, *order) -> pd.DataFrame:
    """Up to `most` different ones of n rows (id, v): the first by order, or by hash, of those with the least hashes, about four
    times as many. Tasks send no more than these between them, however many there are: the first rows of each task, which a plain
    limit sends to the driver, grow with the tasks."""
    share, turn = min(1.0, 4 * most / max(1, n)), F.xxhash64("id", "v")
    few = (rows.where(turn < F.lit(int(share * 2**64) - 2**63)) if share < 1 else rows).select("id", "v", *(["norm"] if order else [])).distinct()
    return few.orderBy(*(order or (turn,)), "id", "v").limit(most).select("id", "v").toPandas()


def _longest(rows: DataFrame, most: int) -> pd.DataFrame:
    """Up to `most` different rows (id, v, norm), the longest ones or, where classes of length are large, long ones."""
    of = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * CLASSES)).otherwise(-1)
    n, low = 0, None
    for low, size in sorted(map(tuple, rows.groupBy(of.alias("class")).count().collect()), reverse=True):  # noqa: B007
        n += size
        if n >= most:
            break
    return _some(rows if low is None else rows.where(of >= low), n, most, F.desc("norm"))


def _kept(found: tuple | list, low: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k best of each query (positions, candidate ids, scores), and the thresholds that they raise."""
    order = np.lexsort((found[1], -found[2], found[0]))
    who = found[0][order]
    nth = np.arange(len(who)) - np.searchsorted(who, who)
    best, full = [c[order][nth < k] for c in found], nth == k - 1
    low = low.copy()
    low[who[full]] = np.maximum(low[who[full]], found[2][order][full])
    return best, low
