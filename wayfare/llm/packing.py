"""Packing tokenised documents into fixed-length sequences as a cutting-stock problem.

Documents longer than a sequence are cut into full pieces and a rest. The lengths of all pieces make a histogram over a
bounded number of classes (exact lengths of short pieces, steps of a few tokens above); a linear program over patterns (how many pieces of each class fill one sequence) is solved by
column generation: the simplex prices the classes, a knapsack dynamic program finds patterns dearer than a sequence.
Patterns are rounded down, what they leave is placed first-fit by descending length, and the pieces of a class, ranked in
parallel, take the places of the class in the patterns.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import in_small_batches, one_blas_thread, persisted, release

if TYPE_CHECKING:
    import pandas as pd  # elsewhere only where frames are made: workers that read Arrow do without it

CAPACITY = 2048
#: Pieces of up to EXACT tokens are in a class of their exact length; longer ones in classes of UNIT tokens, by their longest.
EXACT, UNIT = 128, 8
#: The program ends when it is within this share of a lower bound of its value.
GAP = 1e-3
#: Buckets of a class over which pieces are ranked in parallel; their counts are at most classes x RANK_BUCKETS rows.
RANK_BUCKETS = 512
END_ID = 1
#: Unbroken runs from which the second implementation of the same vocabulary is used, as the first slows down on them.
LONG_RUN = 1000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_LOG = logging.getLogger(__name__)


@lru_cache(maxsize=2)
def _encoder(name: str):
    """ids of a text, those of tokenizers' file name.json as it is read: tokens that were added to it get their ids.

    tiktoken gives the same ids faster where the same ranks exist as name.tiktoken; texts that hold an added token or a long
    unbroken run go to tokenizers itself.
    """
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        parts = (text[i : i + LONG_RUN] for i in range(0, len(text) - LONG_RUN + 1, LONG_RUN))
        if any(t in text for t in added) or any(p.isspace() or len(p.split(None, 1)) == 1 for p in parts):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows PIECE (and ids, if asked for): each document's ids and the end id, cut at every capacity ids. One pass, no shuffle."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        release()
        encode = _encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, t in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(t), np.array([END_ID], dtype="<u4")).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((key, at, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part.astype(np.int64),) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)
            yield out.astype({"doc_id": "Int64"})

    return in_small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(cut, PIECE + ", ids array<long>" * with_ids)


def class_sizes(capacity: int = CAPACITY, exact: int = EXACT, unit: int = UNIT) -> np.ndarray:
    """The longest piece of each class, ascending; the last is capacity."""
    exact = min(exact, capacity)
    return np.append(np.arange(1, exact + 1), np.minimum(np.arange(exact + unit, capacity + unit, unit), capacity)).astype(np.int64)


def _table(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to capacity: the highest price of items in it, and an item of such a choice (-1: as with one unit less).

    One item after the other: with j copies of it, best[c] is the greatest of best[c - j size] + j price, a running maximum
    along each residue of the size.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.flatnonzero((prices > 1e-12) & (sizes <= capacity)):
        size, price = int(sizes[k]), prices[k]
        rows = -(-(capacity + 1) // size)
        gain = np.arange(rows)[:, None] * price
        padded = np.pad(best, (0, rows * size - capacity - 1), constant_values=-np.inf).reshape(rows, size)
        more = (np.maximum.accumulate(padded - gain, axis=0) + gain).ravel()[: capacity + 1]
        last[more > best + 1e-12] = k
        best = more
    reached = np.maximum.accumulate(best)
    last[reached > best] = -1
    return reached, last


def _chosen(last: np.ndarray, sizes: np.ndarray, rooms: np.ndarray) -> np.ndarray:
    """The items that fill each of these rooms by _table's choices: a column of counts for each."""
    at = rooms.copy()
    counts, live = np.zeros((len(sizes), len(at)), dtype=np.int64), np.flatnonzero(at > 0)
    while len(live):
        k = last[at[live]]
        took = k >= 0
        counts[k[took], live[took]] += 1
        at[live] -= np.where(took, sizes[k], 1)
        live = live[at[live] > 0]
    return counts


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of items (of these sizes and prices, each as often as wanted) within capacity of the highest price."""
    best, last = _table(prices, sizes, capacity)
    return float(best[-1]), _chosen(last, sizes, np.array([capacity]))[:, 0]


def _program(demand: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Patterns as columns, how often each is used by the linear program that covers the demand, and the count of priced columns.

    The simplex starts from one pattern a class (as many of it as fit). A round prices the classes by the duals; the knapsack
    table gives, for each class, the dearest pattern that holds it, and those dearer than one sequence join the pool, over
    which the simplex goes on. It ends when no pattern is dearer than a sequence, or within GAP of Farley's bound.
    """
    m = len(demand)
    need = demand * (1 + 1e-6 * (np.arange(1, m + 1) * 0.6180339887498949 % 1))  # ties between steps of the simplex are broken
    bound = float(need @ sizes) / capacity  # no packing has fewer sequences, nor the program a lower value
    pool, price = -np.eye(m), np.zeros(m)  # more places than pieces of a class
    basis, cost = np.diag((capacity // sizes).astype(float)), np.ones(m)
    inverse, x = np.linalg.inv(basis), need / np.diag(basis)
    priced = steps = 0
    for done in range(rounds + 1):
        y = cost @ inverse
        worth = np.maximum(y, 0.0)
        best, last = _table(worth, sizes, capacity)
        bound = max(bound, float(need @ worth) / max(float(best[-1]), 1.0))
        if float(cost @ x) <= (1 + GAP) * bound or best[-1] <= 1 + 1e-6 and y.min() >= -1e-6:
            break
        if done == rounds:
            _LOG.warning("the packing program is %.4f over its bound after %d rounds", float(cost @ x) / bound - 1, rounds)
            break
        dear = np.flatnonzero(worth + best[capacity - sizes] > 1 + 1e-6)
        columns = _chosen(last, sizes, capacity - sizes[dear])
        columns[dear, np.arange(len(dear))] += 1
        columns = np.unique(columns, axis=1)
        priced += columns.shape[1]
        pool, price = np.hstack([pool, columns]), np.append(price, np.ones(columns.shape[1]))
        for _ in range(4 * m):
            gain = (cost @ inverse) @ pool - price
            j = int(np.argmax(gain))
            if gain[j] <= 1e-7:
                break
            direction = inverse @ pool[:, j]
            up = np.flatnonzero(direction > 1e-9)
            if not len(up):
                break
            out = up[np.argmin(x[up] / direction[up])]
            basis[:, out], cost[out] = pool[:, j], price[j]
            steps += 1
            if steps % 64 == 0:
                inverse = np.linalg.inv(basis)
                x = inverse @ need
            else:
                factor, theta = inverse[out] / direction[out], max(x[out], 0.0) / direction[out]
                inverse -= np.outer(direction, factor)
                inverse[out] = factor
                x -= theta * direction
                x[out] = theta
        if pool.shape[1] > 6 * m:  # what is far from being used goes; a later round can price it again
            near = np.argsort(price[m:] - (cost @ inverse) @ pool[:, m:], kind="stable")[: 4 * m]
            keep = np.append(np.arange(m), m + near)
            pool, price = pool[:, keep], price[keep]
    _LOG.info("packing program: %d classes, %d rounds, %d columns priced, value %.2f, bound %.2f", m, done, priced, float(cost @ x), bound)
    bought = cost > 0
    return np.round(basis[:, bought]).astype(np.int64), np.linalg.solve(basis, demand)[bought], priced


def cutting_stock(demand: np.ndarray, sizes: np.ndarray | None = None, rounds: int = 1000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) whose places cover the demand of each class with few sequences; sizes ascend to the capacity
    (without: 1, 2, ...). Patterns of a program that has not converged after so many rounds are used, with a warning."""
    sizes = np.arange(1, len(demand) + 1) if sizes is None else sizes
    n, capacity = len(demand), int(sizes[-1])
    wanted = np.flatnonzero(demand > 0)
    if not len(wanted):
        return []
    columns, x, _ = _program(demand[wanted].astype(float), sizes[wanted], capacity, rounds)
    left, out_patterns = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        times = int(np.floor(x[j] + 1e-9))
        if times <= 0:
            continue
        pattern = np.zeros(n, dtype=np.int64)
        pattern[wanted] = columns[:, j]
        out_patterns.append((pattern, times))
        left -= pattern * times
    left = np.maximum(left, 0)
    room: list[int] = []
    filled: list[np.ndarray] = []
    for k in range(n - 1, -1, -1):  # what rounding leaves: first fit by descending length
        at, size = 0, int(sizes[k])
        rest = int(left[k])
        while rest:
            while at < len(room) and room[at] < size:
                at += 1
            if at == len(room):
                room.append(capacity)
                filled.append(np.zeros(n, dtype=np.int64))
            put = min(rest, room[at] // size)
            room[at] -= put * size
            filled[at][k] += put
            rest -= put
    return out_patterns + [(p, 1) for p in filled]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, exact: int = EXACT, unit: int = UNIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed one by one. An empty table gives no rows. Other
    columns of docs are ignored. Only the histogram (one row a class) and the rank offsets reach the driver.
    """
    cut = persisted(pieces(docs, tokenizer, capacity, doc_id, text), "pieces")
    sizes = class_sizes(capacity, exact, unit)
    exact = min(exact, capacity)
    kind = F.when(F.col("length") <= exact, F.col("length")).otherwise(exact + F.ceil((F.col("length") - exact) / unit)).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    placed = cut.withColumns({"kind": kind, "bucket": bucket})
    counts = placed.groupBy("kind", "bucket").count()
    demand = np.zeros(len(sizes), dtype=np.int64)
    for k, n in counts.groupBy("kind").agg(F.sum("count")).collect():
        demand[k - 1] = n
    with one_blas_thread():
        patterns = cutting_stock(demand, sizes)
    # Places of each class: from which rank on, how many in one sequence, first sequence.
    places: list[list[tuple[int, int, int]]] = [[] for _ in demand]
    reached, first = np.zeros(len(demand), dtype=np.int64), 0
    for pattern, times in patterns:
        for c in np.flatnonzero(pattern):
            places[c].append((int(reached[c]), int(pattern[c]), first))
            reached[c] += pattern[c] * times
        first += times
    tables = [np.array(p, dtype=np.int64).reshape(-1, 3) for p in places]

    def sequence(kinds, ranks):
        import pandas as pd

        out = np.zeros(len(kinds), dtype=np.int64)
        k, r = kinds.to_numpy(), ranks.to_numpy()
        for c in np.unique(k):
            at, t = np.flatnonzero(k == c), tables[c - 1]
            j = np.searchsorted(t[:, 0], r[at], side="right") - 1
            out[at] = t[j, 2] + (r[at] - t[j, 0]) // t[j, 1]
        return pd.Series(out)

    sequence = F.pandas_udf(sequence, "long", F.PandasUDFType.SCALAR)
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("kind", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = placed.withColumn("nth", F.row_number().over(within)).join(F.broadcast(starts), ["kind", "bucket"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    put = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank", sequence("kind", "rank").alias("sequence_id"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return put.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"))
