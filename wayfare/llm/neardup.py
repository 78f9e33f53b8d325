"""Near duplicates by Order MinHash with verification by banded alignment.

Words are lower-cased runs of letters and digits; a k-mer is five consecutive words labelled by how often it occurred
before. A sketch takes the ORDER labelled k-mers that come first under one random permutation and keeps the order in which
they stand in the text, so equal sketches speak for equal sequences, not just equal sets. Texts that share one of SKETCHES
sketches are candidates: at similarity 0.8 a sketch agrees with probability 0.51, so all of 20 disagree once in 10^6.

Buckets of up to SMALL texts give all their pairs. In larger ones every text is compared with HUBS hubs: in each of HUBS
lots that a hash deals, the text whose sketches are the most popular (of a family of edited copies, the original and the
copies nearest to it). That is linear in the bucket but misses pairs that are far from all hubs, so the texts of large
buckets that are not yet one class are joined exactly: two texts of similarity 0.8 share one of the first k-mers of both in
any one order of all k-mers (prefix filter), here from rare to common, which leaves what a template says out. Candidates
are verified by an alignment of their labelled k-mers within a band: similarity is aligned / (all - aligned), a link is
0.8 or more. Classes are the connected components of links and equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import SLICE, in_small_batches, persisted, release, spare

WORDS, SIMILARITY = 5, 0.8
SKETCHES, ORDER, SMALL, HUBS = 20, 3, 8, 8
#: Rows of a large bucket in one part of it.
PART = 256
#: Bits of a k-mer by which its texts are counted for the exact join: k-mers that share them count as one, which costs time, not links.
SLOT_BITS = 20
#: Up to so many ids of texts are sent to all tasks to find these texts; more are joined by shuffle.
LOOKED_UP = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (splitmix's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, base, dtype=np.uint64)]))
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of the whole text: differences of a running polynomial hash of its bytes."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    inner = np.zeros(len(raw) + 2, dtype=bool)
    inner[1:-1] = _IS_WORD[raw]
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(raw) + 1)
    running = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    return _mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def labelled_kmers(text: str, k: int = WORDS) -> np.ndarray:
    """Hashes of (k-mer, earlier occurrences) in text order; a text of fewer words is one k-mer, one without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(w))):
        out = _mix(out * np.uint64(3) + w[j : j + n])
    distinct, back = np.unique(out, return_inverse=True)
    if len(distinct) < n:
        order = np.argsort(back, kind="stable")
        run = np.arange(n) - np.searchsorted(back[order], back[order], side="left")
        earlier = np.empty(n, dtype=np.uint64)
        earlier[order] = run.astype(np.uint64)
        out = np.where(earlier > 0, _mix(out + earlier * _BASE), out)  # first ones alike in all texts, with repeats or not
    return out


def sketches(kmers: np.ndarray, m: int = SKETCHES, order: int = ORDER) -> np.ndarray:
    """m hashes of the `order` first k-mers under m permutations, taken in text order."""
    take = min(order, len(kmers))
    seeds = _mix(np.arange(1, m + 1, dtype=np.uint64) * _BASE)
    values = _mix(kmers[None, :] ^ seeds[:, None])
    at = np.sort(np.argpartition(values, take - 1, axis=1)[:, :take], axis=1)
    chosen = kmers[at]
    out = seeds.copy()
    for j in range(take):
        out = _mix(out * np.uint64(3) + chosen[:, j])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """aligned / (len(a) + len(b) - aligned) of the best alignment of two sequences of distinct k-mers in the band that a
    similarity of least allows; 0 as soon as less is certain. Of distinct symbols, the longest common subsequence is the
    longest increasing run of positions."""
    if not len(a) or not len(b):
        return 0.0
    most = least / (1 + least) * (len(a) + len(b))  # matches that least needs
    if min(len(a), len(b)) < most - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = len(a) + len(b) - 2 * most + 1e-9
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < most - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        from bisect import bisect_left

        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        n = len(tails)
    else:
        n = len(j)
    return n / (len(a) + len(b) - n)


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of all nodes of edges (a, b), class the smallest node of the component: large and small stars in turn.

    Each round joins every edge's ends to the smallest neighbour; a round that changes no edge is the last. Before them, each
    node's edges to smaller ones become one edge to the smallest and edges among them, of which hubs have many in common.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    edges = persisted(lowest.select("a", F.col("low").alias("b")).unionByName(edges.join(lowest, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()), "edges")
    before = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b")
        edges = persisted(small.distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("class")), F.struct(F.col("b").alias("node"), F.col("b").alias("class")))).alias("e")).select("e.*").groupBy("node").agg(F.min("class").alias("class"))


def classes(docs: DataFrame, least: float = SIMILARITY, words: int = WORDS, m: int = SKETCHES, order: int = ORDER, small: int = SMALL, hubs: int = HUBS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, rep_id (smallest id with an equal text), class_id (smallest id of the class), keep.

    A null text equals an empty one; rows that repeat an id with another text count as versions of one document. Texts without words are linked to equal texts only. keep is true for one row of each
    class: the one with the smallest id (rows that repeat that id are all kept). Rows with a null id are classes of their
    own with null class_id, and kept. An empty table gives no rows. Other columns are ignored.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                found = [labelled_kmers(t, words) for t in part.column("text").to_pylist()]
                keys = [sketches(kmers, m, order) for kmers in found if len(kmers)]
                n = np.array([len(kmers) for kmers in found], dtype=np.int64)
                ends = np.append(0, np.cumsum(np.where(n > 0, m, 0)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *keys]), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("same"), pa.array(n), lists], ["doc_id", "same", "n", "keys"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                text_a, text_b = (part.column(j).to_pylist() for j in (2, 3))
                held = {t: labelled_kmers(t, words) for t in {*text_a, *text_b}}
                good = [similarity(held[x], held[y], least) >= least for x, y in zip(text_a, text_b, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                for t in batch.column(0).slice(i, SLICE).to_pylist():
                    slots, times = np.unique(labelled_kmers(t, words) >> np.uint64(64 - SLOT_BITS), return_counts=True)
                    n[slots] += times
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["slot", "n"])

    def texts_of(reps: DataFrame) -> DataFrame:
        """Each text of reps (rep and other columns, a row a rep) once, however many rows of the table hold it: what is joined to
        these would else grow with the copies of one text times those of the other."""
        some = F.broadcast(reps) if reps.count() <= LOOKED_UP else reps
        of = read.withColumnRenamed("doc_id", "rep").join(some, "rep")
        return of.groupBy(*reps.columns, "same").agg(F.first("text").alias("text")).drop("same")

    def compared(asked: DataFrame) -> DataFrame:
        asked = persisted(asked, "asked")
        needed = asked.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        texts = persisted(texts_of(persisted(needed, "needed")), "pair_texts")
        one = asked.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        both = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        return persisted(both.select("a", "b", "text_a", "text_b").mapInArrow(verified, "a long, b long").distinct(), "links")

    def missed(known: DataFrame) -> DataFrame | None:
        """All links between texts of different classes that share a large bucket; None if there can be none."""
        held = shared.where(F.col("size") > small).select("key", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("class", "rep").alias("class"))
        mixed = held.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
        hot = persisted(held.join(mixed, "key").select("rep", "class").distinct(), "hot")
        if hot.isEmpty():
            return None
        texts = persisted(texts_of(hot), "hot_texts")
        counts = texts.select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        common = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
        common[counts["slot"].to_numpy()] = np.minimum(counts["n"].to_numpy(), (1 << 32) - 1)

        def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    parts = []
                    for rep, group, t in zip(*(part.column(c).to_pylist() for c in ("rep", "class", "text")), strict=True):
                        kmers = labelled_kmers(t, words)
                        times = common[kmers >> np.uint64(64 - SLOT_BITS)]
                        at = np.lexsort((kmers, times))[: int((1 - least) * len(kmers) + 1e-9) + 1]
                        alone = int(np.searchsorted(times[at], 1, side="right"))  # no other text has these
                        at = at[alone:]
                        parts.append((kmers[at].view(np.int64), np.arange(alone, alone + len(at)), np.full(len(at), rep), np.full(len(at), group), np.full(len(at), len(kmers))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["kmer", "at", "rep", "class", "n"])

        prefix = persisted(texts.mapInArrow(firsts, "kmer long, at long, rep long, class long, n long"), "prefix")
        met = prefix.groupBy("kmer").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("kmer")
        split = prefix.join(met, "kmer")
        x, y = (split.select("kmer", *[F.col(c).alias(f"{c}_{side}") for c in ("at", "rep", "class", "n")]) for side in "xy")
        needed = least / (1 + least) * (F.col("n_x") + F.col("n_y")) - 1e-9
        near = (F.col("class_x") < F.col("class_y")) & (F.col("at_x") <= F.col("n_x") - needed) & (F.col("at_y") <= F.col("n_y") - needed)
        return compared(x.join(y, "kmer").where(near).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct())

    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.md5(body.cast("binary")).alias("same"))
    rows = persisted(in_small_batches(read).mapInArrow(sketched, "doc_id long, same string, n long, keys array<long>"), "sketches")
    groups = persisted(rows.where(F.col("doc_id").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "texts")
    spread = groups.where("n > 0").select("rep", "n", F.explode("keys").alias("key"))
    counts = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = persisted(spread.join(counts, "key"), "buckets")
    popular = shared.groupBy("rep").agg(F.sum(F.least(F.col("size"), F.lit(1 << 40))).alias("popular"))
    lists = shared.where(F.col("size") <= small).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "n"))).alias("l"))
    pair = lambda x, y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"), x["n"].alias("n_a"), y["n"].alias("n_b"))
    all_pairs = lists.select(F.explode(F.flatten(F.transform("l", lambda x, i: F.transform(F.slice(F.col("l"), i + 2, small), lambda y: pair(x, y))))).alias("p")).select("p.*")
    # Rows of a large bucket are dealt over parts; its hubs are sent to each of them.
    parts = F.ceil(F.col("size") / PART).cast("int")
    large = shared.where(F.col("size") > small).join(popular, "rep").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    lot = F.pmod(F.xxhash64("rep"), F.lit(hubs))
    best = [F.max(F.when(lot == i, F.struct("popular", (-F.col("rep")).alias("minus"), "n"))) for i in range(hubs)]
    centres = large.groupBy("key").agg(F.array_compact(F.array(*best)).alias("hubs"), F.max("size").alias("size"))
    centres = centres.select("key", "hubs", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = large.join(centres.drop("size"), ["key", "part"]).groupBy("rep", "n").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs"))
    stars = met.select("rep", "n", F.explode("hubs").alias("h")).select((-F.col("h.minus")).alias("a"), F.col("rep").alias("b"), F.col("h.n").alias("n_a"), F.col("n").alias("n_b"))
    able = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9
    asked = all_pairs.unionByName(stars).where((F.col("a") != F.col("b")) & able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = compared(asked)
    known = components(links)
    more = missed(known)
    if more is not None and not more.isEmpty():
        known = components(links.unionByName(more))
    of = groups.select("same", "rep").join(known.select(F.col("node").alias("rep"), "class"), "rep", "left").select("same", "rep", F.coalesce("class", "rep").alias("class"))
    out = rows.select("doc_id", "same").join(of, "same", "left")
    mine = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(mine, F.col("rep")).alias("rep_id"), F.when(mine, F.col("class")).alias("class_id"), (~mine | (F.col("doc_id") == F.col("class"))).alias("keep"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with all their columns, reduced to one row of each class of texts.

    The row of the smallest id stays; of rows that share id and text one (any, if other columns differ). Rows count by their
    texts, whatever their ids: rows that share an id but are no near copies all stay. A null text equals an empty one, a null
    id comes after all others. Texts are told apart by 64 bits of their hash. An empty table gives no rows.
    """
    node, own = spare(docs, "node"), spare(docs, "own")
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = classes(docs.select(body.alias("doc_id"), F.col(text).alias("text"))).select(F.col("doc_id").alias("node"), "class_id").distinct()
    rows = docs.select(body.alias("node"), F.col(doc_id).alias("id")).groupBy("node", "id").count()
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "count")).alias("first"))
    kept = persisted(first.join(found, "node").groupBy("class_id").agg(F.min("first").alias("first")).select(F.col("first.node").alias(node), F.col("first.id").alias(own), F.col("first.count").alias("count")), "kept")
    stay = lambda some: docs.join(some.drop("count"), (body == F.col(node)) & F.col(doc_id).eqNullSafe(F.col(own)), "left_semi")
    out = stay(kept.where("count = 1"))
    repeated = kept.where("count > 1")
    return out if repeated.isEmpty() else out.unionByName(stay(repeated).withColumn(node, body).dropDuplicates([node, doc_id]).drop(node))
