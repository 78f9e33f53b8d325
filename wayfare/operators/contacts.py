"""Contacts: pairs of nodes that come close in an epoch, by closest approach of moving points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import geo, rng
from wayfare.operators.partition import BOX, Partition, partition
from wayfare.sources.sinks import checkpointed

AXES = ("x", "y", "z")
#: What passes beyond reach before distances are computed, as a share of the squares that are added: far over their rounding.
SLACK = 1e-12


@dataclass(frozen=True)
class Condition:
    """One line of a conditions file: type distance, probability, null or doYouHaveEnoughUpdates; whenhaveisawu is cooldown()."""

    name: str
    type: str
    dist: float = 0.0
    prob: float = 1.0
    transition_time: float = 0.0

    def predicate(self, seed: int = 1) -> Column:
        if self.type == "distance":
            return F.col("distance") <= self.dist
        if self.type == "probability":
            return rng.uniform(seed, "epoch", "node1", "node2") <= self.prob
        if self.type in ("null", "doYouHaveEnoughUpdates", "whenhaveisawu"):
            return F.lit(True)
        raise ValueError(f"unknown condition type {self.type!r}")


def read_conditions(spec: dict) -> tuple[list[Condition], str]:
    """Conditions of a parsed file, and their description."""
    if "conditions" not in spec:
        raise ValueError("a conditions file needs the key 'conditions'")
    fields = {"dist", "prob", "transition_time"}
    out = [Condition(c["name"], c["type"], **{k: float(v) for k, v in c.get("params", {}).items() if k in fields}) for c in spec["conditions"]]
    for c in out:
        c.predicate()
    return out, " and ".join(c.name for c in out)


def moves(segments: DataFrame) -> DataFrame:
    """Segments as places at prev (p) and velocities (v)."""
    cols = {f"p{a}": geo.at_time(F.col("start"), F.col("end"), a, F.col("prev")) for a in AXES} | {f"v{a}": geo.velocity(F.col("start"), F.col("end"), a) for a in AXES}
    return segments.withColumns(cols).drop("start", "end")


def contacts(segments: DataFrame, reach: float, cell: float | None = None, by: list[str] | None = None, most_cells: int = 64) -> DataFrame:
    """(by..., epoch, node1 < node2, prev, now, t, time, distance, x, y, z) of pairs whose least distance is at most reach.

    t is the time of closest approach, time its epoch's nearer end; x, y, z the (absolute) midpoint as float. Pairs are sought
    only where the boxes around two segments, widened by half of reach, overlap: the boxes are stored, a partition of the
    plane that follows their density is made from a sample, each box is listed in the leaves that it overlaps, and lists meet
    by (epoch, leaf); a pair counts in the leaf that holds the lower corner of what its boxes share. A leaf that stays
    crowded is cut into tiles of pairs of lots; where no cut saves more pairs than it copies boxes, all pairs of an epoch meet.
    With cell: cells of that side instead of leaves; boxes of over most_cells
    cells are joined with all boxes of their epoch. Segments without a place meet nobody.
    """
    keys = [*(by or []), "epoch"]
    m = moves(segments)
    if cell is not None:
        return _by_grid(m, reach, cell, keys, most_cells)
    return by_partition(*boxed(m, reach, keys), reach, keys)


def boxed(m: DataFrame, reach: float, keys: list[str]) -> tuple[DataFrame, Partition]:
    """Moves with the boxes around them, widened by half of reach and stored, and a partition of the plane that follows their density."""
    for ax in ("x", "y"):
        other = F.col(f"p{ax}") + F.col(f"v{ax}") * (F.col("now") - F.col("prev"))
        m = m.withColumns({f"lo_{ax}": F.least(F.col(f"p{ax}"), other) - reach / 2 - 1e-9, f"hi_{ax}": F.greatest(F.col(f"p{ax}"), other) + reach / 2 + 1e-9})
    m = checkpointed(m)
    return m, partition(m, [*keys, "node"])


def by_partition(m: DataFrame, found: Partition, reach: float, keys: list[str]) -> DataFrame:
    """contacts() of moves that boxed() has given."""
    if found.depth == 0 and max(found.tiles) == 1:
        return _all_pairs(m.drop(*BOX), reach, keys)
    listed = m.withColumn("leaf", F.explode(found.leaves()))
    at = [*keys, "leaf"]
    tiles, deal = max(found.tiles), ([], [])
    if tiles > 1:
        listed = listed.withColumn("tiles", found.tile()).withColumn("lot", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        each = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        deal, at = ([F.col("lot").alias("tile1"), each.alias("tile2")], [each.alias("tile1"), F.col("lot").alias("tile2")]), [*at, "tile1", "tile2"]
    a, b = (listed.select("*", *d).repartition(_parts(m), *at) for d in deal) if tiles > 1 else [listed.repartition(_parts(m), *at)] * 2
    a = _side(a, 1, at, BOX)
    b = _side(b, 2, at, BOX)
    if found.depth:
        a = a.withColumns({f"leaf_{k}": found.side(k) for k in range(4)})
    first = "node1 < node2 and lo_x1 <= hi_x2 and lo_x2 <= hi_x1 and lo_y1 <= hi_y2 and lo_y2 <= hi_y1"
    if found.depth:
        first += " and greatest(lo_x1, lo_x2) >= leaf_0 and greatest(lo_x1, lo_x2) < leaf_1 and greatest(lo_y1, lo_y2) >= leaf_2 and greatest(lo_y1, lo_y2) < leaf_3"
    # Sizes of files say little of what explodes: never by broadcast.
    return _near(a.hint("merge").join(b, at), reach, keys, first)


def contacts_of_all_pairs(segments: DataFrame, reach: float, by: list[str] | None = None) -> DataFrame:
    """contacts() by a plain equi-join of all pairs of an epoch, for few nodes."""
    return _all_pairs(moves(segments), reach, [*(by or []), "epoch"])


#: Candidates of an epoch that nodes meet in the first round of first_contacts, about, and how many times more in each later one.
FIRST_LOT, WIDER = 64, 4
#: Rows up to which one side of a round is broadcast.
FEW_ROWS = 200_000


def first_contacts(segments: DataFrame, reach: float) -> DataFrame:
    """(node, birth): the time of each node's first contact, as births() of contacts() gives it, without all contacts.

    Nodes meet lots of the others in rounds, small lots first, dealt by hash. What a node has found so far bounds what it still
    asks: an epoch that does not begin before its earliest contact can't hold an earlier one. Where nodes meet many, most are
    done after the first lots; one that meets nobody is compared with all, as in contacts(). Each other node is in exactly one
    lot, so all pairs that can matter are looked at.
    """
    keys = ["epoch"]
    m = checkpointed(moves(segments).withColumn("turn", F.pmod(F.xxhash64("node"), F.lit(1 << 30))))
    most = m.groupBy("epoch").count().agg(F.max("count")).first()[0] or 0
    asks, found, low, lot = m, None, 0, FIRST_LOT
    while most and low < 1 << 30:
        high = min(1 << 30, low + max(1, (lot << 30) // most))
        others = m.where((F.col("turn") >= low) & (F.col("turn") < high))
        pairs = _met(_side(asks, 1, keys), _side(others, 2, keys), keys, asks.count(), others.count(), _parts(m))
        near = _near(pairs.where("node1 <> node2"), reach, keys, "node1 <> node2")
        best = near.groupBy(F.col("node1").alias("node")).agg(F.min("time").alias("birth"))
        found = checkpointed(best if found is None else best.unionByName(found).groupBy("node").agg(F.min("birth").alias("birth")))
        asks = checkpointed(asks.join(found, "node", "left").where("birth is null or prev < birth").drop("birth"))
        if asks.isEmpty():
            break
        low, lot = high, lot * WIDER
    return found if found is not None else m.select("node", F.col("prev").alias("birth")).limit(0)


def _met(a: DataFrame, b: DataFrame, keys: list[str], n_a: int, n_b: int, parts: int) -> DataFrame:
    """a joined with b by keys: the smaller one broadcast if it is small, else dealt to tiles, so that no task holds a whole key."""
    if min(n_a, n_b) <= FEW_ROWS:
        # Either side may be in few files: its rows are dealt anew.
        return a.repartition(parts).join(F.broadcast(b), keys) if n_b <= n_a else b.repartition(parts).join(F.broadcast(a), keys)
    tiles = max(1, n_b // FEW_ROWS)
    a = a.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("deal", F.pmod(F.xxhash64("node1"), F.lit(parts)).cast("int"))
    b = b.withColumn("tile", F.pmod(F.xxhash64("node2"), F.lit(tiles)).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return a.hint("merge").join(b, [*keys, "tile", "deal"])


def _all_pairs(m: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    m = m.repartition(_parts(m), *keys)
    a, b = (_side(m, i, keys) for i in (1, 2))
    return _near(a.hint("merge").join(b, keys), reach, keys)


def _parts(df: DataFrame) -> int:
    """Work grows with pairs, not bytes: a given number of partitions, which adaptive execution does not coalesce."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _by_grid(m: DataFrame, reach: float, cell: float, keys: list[str], most_cells: int) -> DataFrame:
    parts = _parts(m)
    box = m
    for ax in ("x", "y"):
        other = F.col(f"p{ax}") + F.col(f"v{ax}") * (F.col("now") - F.col("prev"))
        box = box.withColumns({f"lo_{ax}": F.floor((F.least(F.col(f"p{ax}"), other) - reach / 2 - 1e-9) / cell).cast("long"), f"hi_{ax}": F.floor((F.greatest(F.col(f"p{ax}"), other) + reach / 2 + 1e-9) / cell).cast("long")})
    wide = (F.col("hi_x") - F.col("lo_x") + 1) * (F.col("hi_y") - F.col("lo_y") + 1) > most_cells
    box = box.withColumn("wide", wide)
    listed = box.where("not wide").withColumn("cx", F.explode(F.sequence("lo_x", "hi_x"))).withColumn("cy", F.explode(F.sequence("lo_y", "hi_y"))).repartition(parts, *keys, "cx", "cy")
    extra = ["lo_x", "lo_y"]
    a, b = (_side(listed, i, keys, [*extra, "cx", "cy"]) for i in (1, 2))
    b = b.withColumnsRenamed({"cx2": "cx1", "cy2": "cy1"})
    small = a.hint("merge").join(b, [*keys, "cx1", "cy1"]).where("node1 < node2 and cx1 = greatest(lo_x1, lo_x2) and cy1 = greatest(lo_y1, lo_y2)")
    a, b = _side(box.where("wide"), 1, keys), _side(box, 2, keys, ["wide"])
    large = a.join(b, keys).where("node1 <> node2 and (not wide2 or node1 < node2)")
    cols = [*keys, "node1", "node2", "prev", "now", *[f"{k}{ax}{i}" for i in (1, 2) for k in "pv" for ax in AXES]]
    both = small.select(*cols).unionByName(large.select(*cols))
    swap = {f"{k}{ax}{i}": F.when(F.col("node1") <= F.col("node2"), F.col(f"{k}{ax}{i}")).otherwise(F.col(f"{k}{ax}{3 - i}")) for i in (1, 2) for k in "pv" for ax in AXES}
    return _near(both.withColumns(swap | {"node1": F.least("node1", "node2"), "node2": F.greatest("node1", "node2")}), reach, keys)


def contacts_of(segments: DataFrame, nodes: list, reach: float) -> DataFrame:
    """contacts() of which one end at least is among nodes, which are few: their moves are broadcast."""
    m = checkpointed(moves(segments))
    few, dealt = m.where(F.col("node").isin(nodes)), m.repartition(_parts(m))
    after = _side(dealt, 1, ["epoch"]).join(F.broadcast(_side(few, 2, ["epoch"])), "epoch")
    before = F.broadcast(_side(few, 1, ["epoch"])).join(_side(dealt, 2, ["epoch"]), "epoch").where(~F.col("node2").isin(nodes))
    return _near(after, reach, ["epoch"]).unionByName(_near(before, reach, ["epoch"]))


def _side(m: DataFrame, i: int, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    shared = [F.col("prev"), F.col("now")] if i == 1 else []
    return m.select(*keys, *shared, F.col("node").alias(f"node{i}"), *[F.col(f"{k}{a}").alias(f"{k}{a}{i}") for k in "pv" for a in AXES], *[F.col(c).alias(f"{c}{i}") for c in extra or []])


def _reached(reach: float) -> Column:
    """Whether the least distance is about reach or less, by the squared distance a + 2 b t + c t^2 at both ends of the epoch and
    between them. Short, as it stands in the join condition and is evaluated for every pair. Its terms cancel, so that a pair at
    exactly reach may come out beyond it: a little more passes here, and _near decides by the distance itself."""
    p, v = ([F.col(f"{k}{x}1") - F.col(f"{k}{x}2") for x in AXES] for k in "pv")
    dot = lambda m, n: sum((x * y for x, y in zip(m[1:], n[1:], strict=True)), m[0] * n[0])
    a, b, c, span = dot(p, p), dot(p, v), dot(v, v), F.col("now") - F.col("prev")
    square, less = reach * reach * (1 + SLACK), 1 - SLACK
    return (a <= square) | (a * less + span * (2 * b + c * span) <= square) | ((b < 0) & (-b < c * span) & (a * c * less - b * b <= square * c))


def _near(pairs: DataFrame, reach: float, keys: list[str], first: str = "node1 < node2") -> DataFrame:
    # The last term, true by the first one, is a function over an array: it keeps the join out of whole-stage code. Its loop and
    # these terms in one method would be over the 8,000 bytes that the JVM compiles, and all pairs would be interpreted (over
    # 300 s instead of 8 on 173,000 segments).
    near = pairs.where(F.expr(first) & _reached(reach) & F.exists(F.array("node2"), lambda n: n != F.col("node1")))
    return _outcome(near, keys).where(F.col("distance") <= reach)


def _outcome(near: DataFrame, keys: list[str]) -> DataFrame:
    span = F.col("now") - F.col("prev")
    p, v = ([F.col(f"{k}{a}1") - F.col(f"{k}{a}2") for a in AXES] for k in "pv")
    near = near.withColumn("after", geo.closest_after(p, v, span))
    apart = F.sqrt(sum(((x + y * F.col("after")) * (x + y * F.col("after")) for x, y in zip(p, v, strict=True)), F.lit(0.0)))
    t = F.col("prev") + F.col("after")
    middle = {a: (F.abs(F.col(f"p{a}1") + F.col(f"v{a}1") * F.col("after") + F.col(f"p{a}2") + F.col(f"v{a}2") * F.col("after")) / 2).cast("float") for a in AXES}
    return near.select(*keys, "node1", "node2", "prev", "now", t.alias("t"), geo.snapped(t, F.col("prev"), F.col("now")).alias("time"), apart.alias("distance"), *[c.alias(a) for a, c in middle.items()])


def reach_of(conditions: list[Condition], most: float) -> float:
    """The distance within which all contacts lie that can meet the conditions, at most `most`: farther pairs need not be found."""
    return min([most, *(c.dist for c in conditions if c.type == "distance")])


def meeting(contacts: DataFrame, conditions: list[Condition], seed: int = 1) -> DataFrame:
    """Contacts that meet all stateless conditions; a whenhaveisawu condition is applied after them."""
    for c in conditions:
        contacts = contacts.where(c.predicate(seed))
    for c in conditions:
        if c.type == "whenhaveisawu":
            contacts = cooldown(contacts, c.transition_time)
    return contacts


def cooldown(contacts: DataFrame, transition_time: float, by: list[str] | None = None) -> DataFrame:
    """Contacts of a pair of which each comes at least transition_time after the last accepted one.

    t is compared with the accepted contact's snapped time; a pair has one contact an epoch at most. Every contact's successor,
    the first later one far enough from it, is found in one sorted window over contacts and the times they wait for. Where no
    contact waits longer than for the next one, all are accepted. Of the other pairs the contacts that a chain of successors
    reaches from the first one are found by pointer doubling, in at most as many rounds as the longest pair's contacts have
    bits: no array, and no pair's contacts in one row.
    """
    keys = [*(by or []), "node1", "node2"]
    pair = Window.partitionBy(*keys)
    contacts = checkpointed(contacts)  # read twice
    rows = contacts.select(*keys, "epoch", "t", "time")
    events = rows.withColumn("e", F.explode(F.array(F.struct(F.col("t").alias("at"), F.lit(0).alias("asks")), F.struct((F.col("time") + transition_time).alias("at"), F.lit(1).alias("asks"))))).select(*keys, "epoch", "e.at", "e.asks")
    # From the latest backwards, contacts before those that ask for the same time: the least epoch so far is the successor.
    backwards = pair.orderBy(F.desc("at"), "asks", F.desc("epoch")).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("found", F.min(F.when(F.col("asks") == 0, F.col("epoch"))).over(backwards))
    asked = events.where("asks = 1").withColumn("next", F.lead("epoch").over(pair.orderBy("epoch")))
    # A contact that is snapped back may find itself or an earlier one.
    links = asked.select(*keys, "epoch", F.when(F.col("found").isNotNull(), F.greatest("found", "next")).alias("to"), "next", F.min("epoch").over(pair).alias("first"), F.count("*").over(pair).alias("n"))
    skips = F.max(F.when(F.col("next").isNotNull() & ~F.col("to").eqNullSafe(F.col("next")), 1).otherwise(0)).over(pair)
    links = checkpointed(links.withColumn("skips", skips).where("skips = 1").select(*keys, "epoch", "to", "first", "n"))
    longest = links.agg(F.max("n")).first()[0]
    if longest is None:
        return contacts
    kept, jump = links.where("epoch = first").select(*keys, "epoch"), links.where("to is not null").select(*keys, "epoch", "to")
    for _ in range(max(1, int(longest - 1).bit_length())):
        ahead = kept.join(jump, [*keys, "epoch"]).select(*keys, F.col("to").alias("epoch"))
        kept = checkpointed(kept.unionByName(ahead).distinct())
        if jump.isEmpty():
            break
        twice = jump.select(*keys, F.col("epoch").alias("from"), F.col("to").alias("epoch")).join(jump, [*keys, "epoch"])
        jump = checkpointed(twice.select(*keys, F.col("from").alias("epoch"), "to"))
    dropped = links.join(kept, [*keys, "epoch"], "left_anti").select(*keys, "epoch")
    return contacts.join(dropped, [*keys, "epoch"], "left_anti")
