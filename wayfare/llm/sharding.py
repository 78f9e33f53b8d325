"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every shard (leaf) draws an exponential arrival time -ln(u) / weight from a hash of the document's key and its own
place in the tree; a rack's draw is the earliest of its shards', a region's the earliest of its racks', which makes a
subtree's draw exponential with its weight. A document descends from the root to the child with the earliest draw. The law
that holds is ``key``: the key and the tree decide alone. Because a subtree's draw is the minimum of draws that do not change
when another leaf is added, removed or reweighted, rows move only into or out of the subtrees whose weight changed; one more
shard takes rows only into itself. (Independent draws of subtrees by their sums of weights would be fewer, but rows that a
grown rack draws would then land in its old shards too.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sub-buckets of a shard over which slots are numbered in parallel; their counts (shards x 4096 rows) are the only thing broadcast.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(n_shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    """n shards of equal weight, filled rack by rack and region by region."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    return [Leaf(i // (shards_per_rack * racks_per_region), i // shards_per_rack % racks_per_region, i) for i in range(n_shards)]


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _draw(key: Column, place: Column, weight: Column) -> Column:
    """Exponential arrival time of one leaf: 13 hex digits (52 bits) of an md5 make u."""
    digest = F.md5(F.concat(key, place).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard at which a key ends, as a Column without any join or shuffle; ties go to the first region, rack and shard.

    The tree is one literal, regions of racks of shards, and each level takes the earliest of the level below: the size of the
    expression does not grow with the tree.
    """
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a tree needs leaves, each of a positive weight")
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for x in sorted(tree, key=lambda x: (x.region, x.rack, x.shard)):
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    leaf = lambda x: f"named_struct('place', '/{x.region}/{x.rack}/{x.shard}', 'weight', {float(x.weight)!r}D, 'shard', {x.shard})"
    literal = F.expr(f"array({', '.join(f'array({", ".join(f"array({", ".join(map(leaf, rack))})" for rack in racks.values())})' for racks in regions.values())})")
    text = _key(key)
    earliest = lambda draws: F.array_min(draws)
    shard = lambda x: F.struct(_draw(text, x["place"], x["weight"]).alias("draw"), x["shard"].alias("shard"))
    found = earliest(F.transform(literal, lambda racks: earliest(F.transform(racks, lambda shards: earliest(F.transform(shards, shard))))))
    return found["shard"].cast("int")


def assign(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 within a shard), grown_shard.

    A null key is the key "null"; repeated keys go to the same shard, each with a slot of its own. A null text has size 1
    and the crc32 of no bytes, 0. An empty table gives no rows. Other columns of docs are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    bucket = F.conv(F.substring(F.md5(_key(F.col(key)).cast("binary")), 1, 3), 16, 10).cast("int") % SLOT_BUCKETS
    placed = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), descend(F.col(key), tree).alias("shard"), (descend(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), bucket.alias("bucket"))
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("nth", F.row_number().over(within))
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), "grown_shard")
