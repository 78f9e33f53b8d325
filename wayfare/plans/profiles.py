"""Queries over profiles, districts, mobility graphs, workloads and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.ranks import numbered, numbered_keys
from wayfare.operators import encounters, generate, mobility, profiles, routing
from wayfare.plans import adapters as a
from wayfare.plans.registry import query
from wayfare.plans.trajectories import r
from wayfare.sources.sinks import checkpointed


@query(f"WITH {a.TRAJ} SELECT node, round(t, 6) AS t, CASE WHEN t <= 259200 THEN 1 WHEN t <= 518400 THEN 2 ELSE 3 END AS part FROM traj")
def dp_time_split(spark, d):
    return profiles.time_split(a.traj(spark, d), 0.0, 30 * a.DAY).select("node", r("t", 6), "part")


@query(f"WITH {a.TRAJ}, k AS (SELECT node, t, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY t) AS nth FROM traj) SELECT node, round(t, 6) AS t, nth <= floor(greatest(n * 0.1e0, 1)) AS in_profile FROM k WHERE n > floor(greatest(n * 0.1e0, 1))")
def profile_head_split(spark, d):
    return profiles.head_split(a.traj(spark, d)).select("node", r("t", 6), "in_profile")


@query(f"WITH {a.TRAJ}, k AS (SELECT node, min(t) AS t FROM traj GROUP BY node) SELECT node, row_number() OVER (ORDER BY t, node) <= ceil((SELECT count(*) FROM k) * 0.9e0) AS regular FROM k")
def node_split_90_10(spark, d):
    return profiles.node_split(a.traj(spark, d))


@query(f"WITH {a.TRAJ} SELECT node, count(*) AS events FROM traj GROUP BY node HAVING count(*) > 60")
def nodes_with_events(spark, d):
    return profiles.minimum_events(a.traj(spark, d), 60).groupBy("node").agg(F.count("*").alias("events"))


@query(f"WITH {a.TRAJ} SELECT round(min(x), 4) AS min_x, round(max(x), 4) AS max_x, round(min(y), 4) AS min_y, round(max(y), 4) AS max_y, round(min(z), 4) AS min_z, round(max(z), 4) AS max_z FROM traj")
def bounding_box(spark, d):
    return profiles.bounding_box(a.traj(spark, d)).select(*[r(f"{n}_{c}") for c in "xyz" for n in ("min", "max")])


_UNITS = float(profiles.UNITS)


def _units_sql(share: str) -> str:
    """Similarity by whole units, as in the operator."""
    square = "((a.cx - b.cx)::DOUBLE * (a.cx - b.cx) + (a.cy - b.cy)::DOUBLE * (a.cy - b.cy))"
    own = f"sum(CASE WHEN {square} = 0 THEN CAST(floor({share} * {_UNITS:.0f}e0 + 0.5e0) AS BIGINT) ELSE 0 END)"
    rest = f"sum(CASE WHEN {square} = 0 THEN 0 ELSE CAST(floor({share} / sqrt({square}) * {_UNITS:.0f}e0 + 0.5e0) AS BIGINT) END)"
    return f"CAST({own} AS DOUBLE) / {_UNITS:.0f}e0 + CAST({rest} AS DOUBLE) / {_UNITS:.0f}e0 / {a.SCALE:.0f}e0"


@query(f"""WITH {a.CELLS}, gen AS (SELECT cx, cy, sum(visits)::DOUBLE / (SELECT sum(visits) FROM cells)::DOUBLE AS score FROM cells GROUP BY cx, cy),
gsim AS (SELECT a.cx, a.cy, {_units_sql("b.score")} AS general FROM gen a, gen b GROUP BY ALL),
own AS (SELECT node, cx, cy, visits::DOUBLE / sum(visits) OVER (PARTITION BY node)::DOUBLE AS score FROM cells),
home AS (SELECT node AS destination, cx, cy FROM cells QUALIFY row_number() OVER (PARTITION BY node ORDER BY visits DESC, reached, cx, cy) = 1),
asked AS (SELECT o_orderkey AS message_id, o_custkey AS node, o_orderkey % 997 AS destination, home.cx, home.cy FROM orders LEFT JOIN home ON home.destination = o_orderkey % 997),
addr AS (SELECT node, cx, cy FROM asked WHERE cx IS NOT NULL UNION SELECT node, cx, cy FROM cells),
sim AS (SELECT a.node, a.cx, a.cy, {_units_sql("b.score")} AS similarity FROM addr a JOIN own b ON a.node = b.node GROUP BY ALL),
marg AS (SELECT node, cx, cy, similarity / nullif(general, 0) AS marginal FROM sim JOIN gsim USING (cx, cy)),
lim AS (SELECT node, min(marginal) AS threshold FROM marg JOIN cells USING (node, cx, cy) GROUP BY node)
SELECT message_id, asked.node, destination, asked.cx, asked.cy, coalesce(marginal >= threshold, FALSE) AS accepted FROM asked LEFT JOIN marg ON marg.node = asked.node AND marg.cx = asked.cx AND marg.cy = asked.cy LEFT JOIN lim ON lim.node = asked.node""")
def ppbr_accepts(spark, d):
    """Orders as messages that ask their customer's node to carry them: addressed to the destination's cell, taken or not."""
    cells = checkpointed(a.cells(spark, d))
    home = profiles.popular_cell(cells).select(F.col("node").alias("destination"), *profiles.CELL)
    messages = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 997).alias("destination"))
    return profiles.accepted(profiles.addressed(messages, home), cells, a.SCALE).select("message_id", "node", "destination", "cx", "cy", "accepted")


@query(f"WITH {a.CELLS} SELECT node, cx, cy, visits, round(reached, 6) AS reached FROM cells")
def cell_profile(spark, d):
    return a.cells(spark, d).select("node", "cx", "cy", "visits", r("reached", 6))


@query(f"WITH {a.CELLS} SELECT node, cx, cy, visits FROM cells QUALIFY row_number() OVER (PARTITION BY node ORDER BY visits DESC, reached, cx, cy) = 1")
def popular_cell(spark, d):
    return profiles.popular_cell(a.cells(spark, d)).select("node", "cx", "cy", "visits")


@query(f"WITH {a.GENERAL} SELECT cx, cy, round(general, 6) AS similarity FROM gsim")
def general_similarity(spark, d):
    return profiles.general_similarity(profiles.general_scores(a.cells(spark, d)), a.SCALE).select("cx", "cy", r("similarity", 6))


@query(f"WITH {a.OWN} SELECT node, cx, cy, round(similarity, 6) AS similarity, round(marginal, 6) AS marginal FROM marg")
def node_similarity(spark, d):
    return profiles.marginal_similarity(a.cells(spark, d), a.SCALE).select("node", "cx", "cy", r("similarity", 6), r("marginal", 6))


@query(f"WITH {a.OWN} SELECT node, round(min(marginal), 6) AS threshold FROM marg GROUP BY node")
def ppbr_thresholds(spark, d):
    return profiles.thresholds(a.cells(spark, d), a.SCALE).select("node", r("threshold", 6))


@query(f"WITH {a.PLACED} SELECT node, round(t, 6) AS t, district FROM placed")
def nearest_district(spark, d):
    return a.placed(spark, d).select("node", r("t", 6), "district")


@query(f"WITH {a.PLACED} SELECT district, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM placed GROUP BY district")
def kmeans_step(spark, d):
    return mobility.lloyd_step(a.traj(spark, d), a.CENTRES).select("district", "n", r("x"), r("y"))


@query(f"WITH {a.TOP} SELECT node, district, visits, CAST(rank AS INT) AS rank FROM top")
def district_topk(spark, d):
    return a.top(spark, d).select("node", "district", "visits", "rank")


@query(f"WITH {a.EDGES} SELECT node, d1, d2 FROM edges")
def pmg_edges(spark, d):
    return a.edges(spark, d)


_N = len(a.CENTRES)
_RANDOM = f"{a.EDGES}, nodes AS (SELECT DISTINCT node FROM traj), flips AS (SELECT node, CAST(i AS INT) AS d1, CAST(j AS INT) AS d2 FROM nodes, range({_N}) AS x(i), range({_N}) AS y(j) WHERE i < j AND {a.uniform_sql(4, 'node', 'i', 'j')} >= 0.6e0), rr AS (SELECT coalesce(e.node, f.node) AS node, coalesce(e.d1, f.d1) AS d1, coalesce(e.d2, f.d2) AS d2 FROM edges e FULL JOIN flips f ON e.node = f.node AND e.d1 = f.d1 AND e.d2 = f.d2 WHERE e.node IS NULL OR f.node IS NULL)"


@query(f"WITH {_RANDOM} SELECT node, d1, d2 FROM rr")
def pmg_randomised(spark, d):
    return mobility.randomised(a.edges(spark, d), a.traj(spark, d).select("node").distinct(), _N, 0.6, 4)


_WEIGHTS = f"{a.EDGES}, gmg AS (SELECT d1, d2, count(*) / (SELECT count(DISTINCT node) FROM edges)::DOUBLE AS weight FROM edges GROUP BY d1, d2)"


@query(f"WITH {_WEIGHTS} SELECT d1, d2, round(weight, 6) AS weight FROM gmg")
def gmg_weights(spark, d):
    return mobility.graph_weights(a.edges(spark, d)).select("d1", "d2", r("weight", 6))


@query(f"WITH {_WEIGHTS} SELECT d1, d2, round(weight + 0.1e0 * sqrt(-2 * ln(1 - {a.uniform_sql(1, 'd1', 'd2')})) * cos(2 * pi() * (1 - {a.uniform_sql(2, 'd1', 'd2')})), 6) AS noisy, 0.99e0 AS sybil FROM gmg")
def gmg_attacks(spark, d):
    w = mobility.graph_weights(a.edges(spark, d))
    return mobility.attacked(w, "noise").select("d1", "d2", F.round("weight", 6).alias("noisy")).join(mobility.attacked(w, "sybil").select("d1", "d2", F.col("weight").alias("sybil")), ["d1", "d2"])


@query(f"WITH {_WEIGHTS}, w AS (SELECT d1, d2, CASE WHEN weight = 0 THEN 0.1e0 ELSE weight END AS w FROM gmg) SELECT d1, d2, CAST(least(ceil((0.6e0 * w + (1 - 0.6e0) * (1 - w)) / (0.6e0 * w)) * 2, 10) AS BIGINT) AS n FROM w")
def n_values(spark, d):
    return mobility.graph_weights(a.edges(spark, d)).select("d1", "d2", mobility.attempts(F.col("weight"), 0.6, 2, 10).alias("n"))


def _lloyd_sql(steps: int) -> str:
    """Each step's assignment and means, one after another."""
    out = f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY {a.hash_sql(2, 'x', 'y', 'z')}, x, y) - 1 AS INT) AS district, x, y FROM (SELECT DISTINCT x, y, z FROM traj) QUALIFY district < 8)"
    for i in range(steps):
        out += f""", p{i} AS MATERIALIZED (SELECT node, t, p.x, p.y, arg_min(district, ((p.x - c.x) ** 2 + (p.y - c.y) ** 2, district)) AS district FROM traj p, c{i} c GROUP BY node, t, p.x, p.y),
c{i + 1} AS MATERIALIZED (SELECT c.district, coalesce(avg(p.x), any_value(c.x)) AS x, coalesce(avg(p.y), any_value(c.y)) AS y FROM c{i} c LEFT JOIN p{i} p ON p.district = c.district GROUP BY c.district)"""
    return out


@query(f"WITH {a.TRAJ}, {_lloyd_sql(5)} SELECT district, round(x, 4) AS x, round(y, 4) AS y FROM c5")
def kmeans_districts(spark, d):
    """Centres after five Lloyd steps from drawn positions."""
    found = mobility.districts(a.traj(spark, d), 8, 5, seed=2)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(found)], "district int, x double, y double, z double").select("district", r("x"), r("y"))


@query(f"WITH {a.BIRTHS} SELECT a.node AS sender, b.node AS destinationnode, round(a.birth + 10 * (row_number() OVER (PARTITION BY a.node ORDER BY b.node) - 1), 4) AS creation_time FROM births a JOIN births b ON a.node <> b.node")
def group_messages(spark, d):
    return generate.group_messages(a.births(spark, d)).select("sender", "destinationnode", r("creation_time"))


def _bulk_sql(when: str) -> str:
    return f"WITH {a.BIRTHS}, k AS (SELECT node, birth, row_number() OVER (ORDER BY node) - 1 AS nth, (SELECT count(*) FROM births) AS n FROM births), s AS (SELECT node, birth, (nth + 1 + (CAST(floor({a.uniform_sql(6, 'node')} * (n - 1)) AS BIGINT) + i) % (n - 1)) % n AS nth FROM k, range(10) AS g(i) WHERE i < n - 1), m AS (SELECT s.node AS sender, k.node AS destinationnode, s.birth FROM s JOIN k USING (nth)) SELECT sender, destinationnode, round({when}, 4) AS creation_time FROM m"


@query(_bulk_sql("birth"))
def bulk_messages(spark, d):
    return generate.bulk_messages(a.births(spark, d), 6).select("sender", "destinationnode", r("creation_time"))


@query(_bulk_sql(f"birth + {a.uniform_sql(7, 'sender', 'destinationnode')} * 1e0 * (2592000e0 - birth)"))
def gradual_messages(spark, d):
    return generate.bulk_messages(a.births(spark, d), 6, end=30 * a.DAY).select("sender", "destinationnode", r("creation_time"))


@query(_bulk_sql(f"birth + {a.uniform_sql(7, 'sender', 'destinationnode')} * 0.5e0 * (2592000e0 - birth)"))
def half_gradual_messages(spark, d):
    return generate.bulk_messages(a.births(spark, d), 6, end=30 * a.DAY, share=0.5).select("sender", "destinationnode", r("creation_time"))


_DIRECT = f"{a.BIRTHS}, h AS (SELECT *, {a.hash_sql(5, 'node')} AS h FROM births), dm AS (SELECT node AS sender, coalesce(lead(node) OVER (ORDER BY h, node), first(node) OVER (ORDER BY h, node)) AS destinationnode, birth AS creation_time FROM h)"


@query(f"WITH {_DIRECT} SELECT sender, destinationnode, round(creation_time, 4) AS creation_time FROM dm WHERE sender <> destinationnode")
def direct_messages(spark, d):
    return generate.direct_messages(a.births(spark, d), 5).select("sender", "destinationnode", r("creation_time"))


@query(f"WITH {_DIRECT}, e AS (SELECT *, row_number() OVER (ORDER BY time, node1, node2) AS seq FROM enc), w AS (SELECT node1 AS sender, time + duration AS until, seq FROM e UNION ALL SELECT node2, time + duration, seq FROM e) SELECT sender, min(seq) AS seq FROM dm JOIN w USING (sender) WHERE until >= creation_time AND sender <> destinationnode GROUP BY sender")
def originations(spark, d):
    messages, met = a.workload(spark, d)
    ordered = numbered(met, ["time", "node1", "node2"], "seq").withColumn("seq", F.col("seq") + 1)
    return generate.originations(messages, ordered).select("sender", "seq")


_FLOODED = "f AS (SELECT node, birth FROM births)"


def _flooding(spark, d):
    """One flooded message from every node that meets another, and the encounters."""
    met = checkpointed(a.encounter(spark, d, **a.FEW))
    return encounters.births(met).select(F.col("node").cast("string").alias("id"), F.col("node").alias("sender"), F.col("birth").alias("time")), met


@query(f"""WITH {a.BIRTHS}, {_FLOODED}, w AS (SELECT time, node1, node2, node1 AS holder, node2 AS node FROM enc UNION ALL SELECT time, node1, node2, node2, node1 FROM enc),
h1 AS (SELECT f.node AS m, w.node, min((w.time, w.node1, w.node2)) AS arr FROM f JOIN w ON w.holder = f.node AND (w.time, w.node1, w.node2) > (f.birth, -1, -1) GROUP BY ALL),
h2 AS (SELECT h1.m, w.node, min((w.time, w.node1, w.node2)) AS arr FROM h1 JOIN w ON w.holder = h1.node AND (w.time, w.node1, w.node2) > h1.arr GROUP BY ALL),
al AS (SELECT node AS m, node, birth AS time, 0 AS hops FROM f UNION ALL SELECT m, node, arr[1], 1 FROM h1 UNION ALL SELECT m, node, arr[1], 2 FROM h2)
SELECT CAST(m AS VARCHAR) AS message_id, node, round(min(time), 4) AS time FROM al GROUP BY m, node""")
def broadcast_two_hops(spark, d):
    messages, met = _flooding(spark, d)
    return routing.flood(messages, met, max_hops=2, keep=checkpointed).select("message_id", "node", r("time"))


@query()
def broadcast_unbounded(spark, d):
    return routing.flood(*_flooding(spark, d), keep=checkpointed).select("message_id", "node", r("time"), "hops")


def _route(policy, capacity=None):
    def run(spark, d):
        messages, met = a.workload(spark, d)
        return routing.replay(messages, met, policy(spark, d), "run", capacity)

    return run


@query()
def route_broadcast(spark, d):
    """Bounded buffers."""
    return _route(lambda s, d: routing.Broadcast(), 50.0)(spark, d)


@query()
def route_randomwalk_v1(spark, d):
    return _route(lambda s, d: routing.RandomWalk(0.5, 1.0))(spark, d)


@query()
def route_randomwalk_v2(spark, d):
    return _route(lambda s, d: routing.AgedWalk(delete=1.0, constant=10 * a.DAY))(spark, d)


@query()
def route_mixed(spark, d):
    return _route(lambda s, d: routing.Mixed(routing.RandomWalk(0.5, 0.5), 0.3))(spark, d)


def _profiled(spark, d):
    """Which popular cells each receiver accepts. The driver gets a row a node and a number a cell that is somebody's popular one,
    never pairs of nodes."""
    cells = a.cells(spark, d)
    home = checkpointed(profiles.popular_cell(cells).select(F.col("node").alias("destination"), *profiles.CELL))
    nth = numbered_keys(home.select(*profiles.CELL).distinct(), profiles.CELL, checkpointed, "bit")
    asked = cells.select("node").distinct().join(home.select(*profiles.CELL).distinct())
    ok = profiles.accepted(asked, cells, a.SCALE).where("accepted").join(nth, profiles.CELL)
    taken = ok.groupBy("node").agg(F.collect_list(F.col("bit").cast("int")).alias("bits"))
    return routing.ByCell({x[0]: sum(1 << b for b in x[1]) for x in taken.toLocalIterator()}, cell={x[0]: x[1] for x in home.join(nth, profiles.CELL).select("destination", "bit").toLocalIterator()})


@query()
def route_ppbr(spark, d):
    return _route(_profiled)(spark, d)


def _mirage(spark, d):
    graph: dict[int, set] = {}
    nodes = a.traj(spark, d).select("node").distinct()
    for x in mobility.randomised(a.edges(spark, d), nodes, _N, 0.6, 4).collect():
        graph.setdefault(x["node"], set()).add((x["d1"], x["d2"]))
    home = {x["node"]: x["district"] for x in a.top(spark, d, 1).collect()}
    weights = {(x["d1"], x["d2"]): x["weight"] for x in mobility.graph_weights(a.edges(spark, d)).collect()}
    return routing.Mirage(a.CENTRES, graph, home, weights, p=0.6, factor=2, most=10)


@query()
def route_mirage(spark, d):
    return _route(_mirage)(spark, d)


@query()
def routing_summary(spark, d):
    """Deliveries, latency and traffic of runs of three policies."""
    runs = [("flooding", routing.Broadcast()), ("handoff", routing.RandomWalk(1.0, 1.0)), ("aged", routing.AgedWalk(delete=0.0, constant=10 * a.DAY))]
    messages, met = a.workload(spark, d)
    events = None
    for name, policy in runs:
        e = routing.replay(messages, met, policy, name)
        events = e if events is None else events.unionByName(e)
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return events.groupBy("experiment_name").agg(kind("transfer").alias("transfers"), kind("delivery").alias("deliveries"), F.round(F.avg(F.when(F.col("kind") == "delivery", F.col("time") - F.col("creation_time"))), 4).alias("lat_sec"), F.sum("bandwidth").alias("bandwidth"))

