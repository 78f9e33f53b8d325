"""Queries over positions, contacts and encounters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.functions.scalars import bucket10
from wayfare.operators import contacts, encounters, epochs, reports
from wayfare.plans import adapters as a
from wayfare.plans.registry import query
from wayfare.sources.sinks import checkpointed


def r(c, n=4):
    return F.round(F.col(c).cast("double"), n).alias(c)


def rs(*cols, n=4):
    return ", ".join(f"round(CAST({c} AS DOUBLE), {n}) AS {c}" for c in cols)


@query(f"WITH {a.encounter_sql()} SELECT node1, node2, {rs('time', 'duration')}, {rs('x', 'y', n=2)} FROM enc")
def encounters_basic(spark, d):
    return a.encounter(spark, d).select("node1", "node2", r("time"), r("duration"), r("x", 2), r("y", 2))


@query(f"WITH {a.segments_sql()} SELECT node, epoch, {rs('st', 'sx', 'sy', 'et', 'ex', 'ey', n=6)} FROM seg")
def asof_bounds(spark, d):
    s = a.segments(spark, d)
    return s.select("node", "epoch", *[F.round(f"{side}.{c}", 6).alias(f"{side[0]}{c}") for side in ("start", "end") for c in ("t", "x", "y")])


@query(f"WITH {a.segments_sql()} SELECT epoch, count(*) AS nodes, round(min(prev), 4) AS prev FROM ne GROUP BY epoch")
def active_epochs(spark, d):
    return a.segments(spark, d).groupBy("epoch").agg(F.count("*").alias("nodes"), F.round(F.min("prev"), 4).alias("prev"))


@query(f"""WITH {a.TRAJ}, b AS (SELECT min(t) AS f, max(t) AS l FROM traj), k AS (SELECT f, CAST(floor((l - f) / 43200e0) AS BIGINT) AS n FROM b),
e AS (SELECT i AS epoch, f + i * 43200e0 AS prev, f + (i + 1) * 43200e0 AS now, CASE WHEN i + 2 <= n THEN f + (i + 2) * 43200e0 END AS next FROM k, unnest(range(n)) AS u(i))
SELECT epoch, round(prev, 4) AS prev, round(now, 4) AS now, round(next, 4) AS next, (SELECT count(*) FROM traj WHERE t >= prev AND t < now) AS events FROM e""")
def epoch_triples(spark, d):
    """The epochs of the events' whole span, each with the next one's end and its events."""
    t = a.traj(spark, d)
    low, high = t.agg(F.min("t"), F.max("t")).first()
    grid = epochs.epochs(spark, low or 0.0, high or 0.0, 43200.0)
    counts = t.join(grid, F.floor((F.col("t") - F.lit(low)) / 43200.0) == F.col("epoch")).groupBy("epoch").agg(F.count("*").alias("events"))
    return grid.join(counts, "epoch", "left").select("epoch", r("prev"), r("now"), r("next"), F.coalesce("events", F.lit(0)).alias("events"))


@query(f"WITH {a.contact_sql()} SELECT epoch, node1, node2, {rs('time', 'distance')}, {rs('x', 'y', n=2)} FROM contact")
def contacts_closest_approach(spark, d):
    return a.contact(spark, d).select("epoch", "node1", "node2", r("time"), r("distance"), r("x", 2), r("y", 2))


@query(f"WITH {a.contact_sql(reach=1.0)} SELECT epoch, node1, node2, {rs('distance')} FROM contact")
def contacts_by_grid(spark, d):
    """The same join through grid cells."""
    return contacts.contacts(a.segments(spark, d), 1.0, cell=24.0).select("epoch", "node1", "node2", r("distance"))


@query(f"WITH {a.contact_sql()} SELECT epoch, node1, node2, {rs('distance')} FROM contact WHERE {a.uniform_sql(3, 'epoch', 'node1', 'node2')} <= 0.5 AND distance <= 2")
def conditioned_contacts(spark, d):
    spec = {"conditions": [{"name": "near", "type": "distance", "params": {"dist": 2}}, {"name": "coin", "type": "probability", "params": {"prob": 0.5}}, {"name": "updates", "type": "doYouHaveEnoughUpdates", "params": {}}]}
    found, _ = contacts.read_conditions(spec)
    near = a.contact(spark, d, reach=contacts.reach_of(found, a.REACH))
    return contacts.meeting(near, found, seed=3).select("epoch", "node1", "node2", r("distance"))


@query(f"""WITH RECURSIVE {a.contact_sql(**a.FEW)},
o AS (SELECT *, row_number() OVER (PARTITION BY node1, node2 ORDER BY epoch) AS k FROM contact),
g AS (SELECT node1, node2, epoch, k, time AS last, TRUE AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.node1, o.node2, o.epoch, o.k, CASE WHEN o.t - g.last >= 345600 THEN o.time ELSE g.last END, o.t - g.last >= 345600 FROM g JOIN o ON o.node1 = g.node1 AND o.node2 = g.node2 AND o.k = g.k + 1)
SELECT node1, node2, epoch FROM g WHERE kept""")
def cooldown_contacts(spark, d):
    return contacts.cooldown(a.contact(spark, d, **a.FEW).select("epoch", "node1", "node2", "t", "time"), 4 * a.DAY).select("node1", "node2", "epoch")


@query(f"WITH {a.encounter_sql()}, n AS (SELECT *, CASE WHEN duration <= 43200 THEN 1 ELSE CAST(floor(duration / 43200) AS INT) END AS n FROM enc) SELECT node1, node2, CAST(i AS INT) AS part, round(time + i * 43200e0, 4) AS time, round(CASE WHEN duration <= 43200 THEN duration ELSE 43200e0 END, 4) AS duration FROM n, unnest(range(n)) AS u(i)")
def encounter_split(spark, d):
    return encounters.split(a.encounter(spark, d), 2 * a.STEP).select("node1", "node2", "part", r("time"), r("duration"))


@query(f"WITH {a.encounter_sql()}, e AS (SELECT node1 AS node, time FROM enc UNION ALL SELECT node2, time FROM enc) SELECT node, count(*) AS count, round(min(time), 4) AS first_encounter FROM e GROUP BY node")
def encountered_nodes(spark, d):
    return encounters.encountered_nodes(a.encounter(spark, d)).select("node", "count", r("first_encounter"))


@query(f"WITH {a.BIRTHS} SELECT node, round(birth, 4) AS birth FROM births")
def node_births(spark, d):
    return a.births(spark, d).select("node", r("birth"))


@query(f"WITH {a.encounter_sql()}, s AS (SELECT node1 AS node, count(*) AS n, 'node1' AS side FROM enc GROUP BY node1 UNION ALL SELECT node2, count(*), 'node2' FROM enc GROUP BY node2), t AS (SELECT * FROM s ORDER BY n DESC, node, side LIMIT 64) SELECT node1, node2, round(time, 4) AS time, node AS popular, n, side FROM enc JOIN t ON node1 = node OR node2 = node")
def popular_theta_join(spark, d):
    """Encounters are counted without being stored; those of the popular nodes are then found again."""
    top = checkpointed(reports.popular(a.encounter(spark, d)))
    nodes = [x[0] for x in top.select("popular").distinct().collect()]
    met = checkpointed(encounters.merge(contacts.contacts_of(a.segments(spark, d), nodes, a.REACH), a.STEP))
    return reports.popular_encounters(met, top).select("node1", "node2", r("time"), "popular", "n", "side")


@query(f"WITH {a.encounter_sql()} SELECT " + ", ".join(f"round(CAST({n}({c}) AS DOUBLE), 2) AS {n}_{c}" for c in "xy" for n in ("min", "max")) + ", count(*) AS n FROM enc")
def encounter_locations(spark, d):
    return a.encounter(spark, d).agg(*[F.round(f(c).cast("double"), 2).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


@query(f"WITH {a.TRAJ} SELECT node, round(t, 6) AS t, round(x, 4) AS x FROM traj WHERE t BETWEEN 86400 AND 432000")
def range_filter(spark, d):
    return reports.time_range(a.traj(spark, d), 86400.0, 432000.0).select("node", r("t", 6), r("x"))


@query(f"WITH {a.TRAJ} SELECT DISTINCT node FROM traj")
def distinct_nodes(spark, d):
    return reports.distinct_nodes(a.traj(spark, d))


@query(f"WITH {a.TRAJ} SELECT node, round(min(t), 6) AS first, round(max(t), 6) AS last FROM traj GROUP BY node")
def node_time_bounds(spark, d):
    return reports.node_spans(a.traj(spark, d)).select("node", r("first", 6), r("last", 6))


@query(f"WITH {a.TRAJ} SELECT round(min(t), 6) AS first, round(max(t), 6) AS last, count(DISTINCT node) AS nodes FROM traj")
def dataset_span(spark, d):
    return reports.dataset_span(a.traj(spark, d)).select(r("first", 6), r("last", 6), "nodes")


@query(f"WITH {a.TRAJ} SELECT node, count(*) AS events FROM traj GROUP BY node")
def events_per_node(spark, d):
    return reports.events_per_node(a.traj(spark, d))


@query(f"WITH {a.TRAJ} SELECT node, count(*) AS events, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM traj GROUP BY node")
def event_locations(spark, d):
    return reports.mean_positions(a.traj(spark, d)).select("node", "events", r("x"), r("y"), r("z"))


@query(f"WITH {a.TRAJ} SELECT node, count(*) AS events, round(min(t), 6) AS first FROM traj GROUP BY node ORDER BY events DESC, node LIMIT 10")
def topk_nodes(spark, d):
    return reports.top_nodes(a.traj(spark, d), 10).select("node", "events", r("first", 6))


_A, _E2 = "6378137e0", "(2 / 298.257223563e0 - (1 / 298.257223563e0) ** 2)"
_N = f"({_A} / sqrt(1 - {_E2} * sin(radians(y - 45)) ** 2))"


@query(f"WITH {a.TRAJ} SELECT node, round(t, 6) AS t, round(({_N} + 10) * cos(radians(y - 45)) * cos(radians(x)), 3) AS ex, round(({_N} + 10) * cos(radians(y - 45)) * sin(radians(x)), 3) AS ey, round(({_N} * (1 - {_E2}) + 10) * sin(radians(y - 45)), 3) AS ez FROM traj")
def ecef(spark, d):
    x, y, z = geo.ecef(F.col("y") - 45, F.col("x"), F.lit(10.0))
    return a.traj(spark, d).select("node", r("t", 6), F.round(x, 3).alias("ex"), F.round(y, 3).alias("ey"), F.round(z, 3).alias("ez"))


@query(f"WITH {a.TRAJ} SELECT node, round(t, 6) AS t, round({_A} * radians(x), 3) AS mx, round({_A} * ln(tan(pi() / 4 + radians(y - 45) / 2)), 3) + 0e0 AS my FROM traj")
def mercator(spark, d):
    x, y = geo.mercator(F.col("y") - 45, F.col("x"))
    return a.traj(spark, d).select("node", r("t", 6), F.round(x, 3).alias("mx"), (F.round(y, 3) + F.lit(0.0)).alias("my"))


@query(f"WITH {a.TRAJ}, l AS (SELECT min(x) AS low, max(x) AS high FROM traj), c AS (SELECT least(greatest(CAST(floor((x - low) / ((high - low) / 10)) AS INT), 0), 9) AS bucket, count(*) AS count FROM traj, l GROUP BY 1) SELECT bucket, count FROM c")
def position_histogram(spark, d):
    t = a.traj(spark, d)
    limits = F.broadcast(t.agg(F.min("x").alias("low"), F.max("x").alias("high")))
    return t.crossJoin(limits).groupBy(bucket10(F.col("x"), F.col("low"), F.col("high")).alias("bucket")).agg(F.count("*").alias("count"))
