"""The engine's relations as views over the driver's tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import contacts, encounters, epochs, generate, metrics, mobility, profiles
from wayfare.sources.sinks import checkpointed

STEP, EPOCHS, REACH, DAY = 21600.0, 120, 5.0, 86400.0


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(ts: str, since: str = "1970-01-01") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{since} 00:00:00', {ts})") / F.lit(1e6)


def traj(spark: SparkSession, d: str) -> DataFrame:
    """events as positions: t in seconds of 2024, x the value, y the k of the properties."""
    return read(spark, d, "events").select(F.col("user_id").alias("node"), seconds("ts", "2024-01-01").alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.lit(0.0).alias("z"))


TRAJ = "traj AS (SELECT user_id AS node, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, 0e0 AS z FROM events)"


def segments(spark: SparkSession, d: str, step: float = STEP, n: int = EPOCHS) -> DataFrame:
    return epochs.segments(traj(spark, d), step, n)


def segments_sql(step: float = STEP, n: int = EPOCHS) -> str:
    return f"""{TRAJ}, span AS (SELECT node, min(t) AS f, max(t) AS l FROM traj GROUP BY node),
ep AS (SELECT i AS epoch, i * {step:.0f}e0 AS prev, (i + 1) * {step:.0f}e0 AS now FROM range({n}) AS r(i)),
ne AS (SELECT node, epoch, prev, now FROM span JOIN ep ON f < prev AND l > now),
s1 AS (SELECT ne.*, a.t AS st, a.x AS sx, a.y AS sy FROM ne ASOF JOIN traj a ON ne.node = a.node AND ne.prev >= a.t),
seg AS (SELECT s1.*, b.t AS et, b.x AS ex, b.y AS ey FROM s1 ASOF JOIN traj b ON s1.node = b.node AND s1.now <= b.t)"""


def contact(spark: SparkSession, d: str, step: float = STEP, n: int = EPOCHS, reach: float = REACH) -> DataFrame:
    return encounters.met_contacts(segments(spark, d, step, n), reach)


def contact_sql(step: float = STEP, n: int = EPOCHS, reach: float = REACH) -> str:
    return f"""{segments_sql(step, n)},
mv AS (SELECT epoch, node, prev, now, sx + (ex - sx) / (et - st) * (prev - st) AS px, sy + (ey - sy) / (et - st) * (prev - st) AS py, (ex - sx) / (et - st) AS vx, (ey - sy) / (et - st) AS vy FROM seg),
pr AS (SELECT a.epoch, a.node AS node1, b.node AS node2, a.prev, a.now, a.px AS px1, b.px AS px2, a.py AS py1, b.py AS py2, a.vx AS vx1, b.vx AS vx2, a.vy AS vy1, b.vy AS vy2 FROM mv a JOIN mv b ON a.epoch = b.epoch AND a.node < b.node),
ca AS (SELECT *, CASE WHEN (vx1 - vx2) ** 2 + (vy1 - vy2) ** 2 = 0 THEN 0e0 ELSE least(now - prev, greatest(0e0, -((px1 - px2) * (vx1 - vx2) + (py1 - py2) * (vy1 - vy2)) / ((vx1 - vx2) ** 2 + (vy1 - vy2) ** 2))) END AS after FROM pr),
contact AS (SELECT epoch, node1, node2, prev, now, prev + after AS t, CASE WHEN abs(after) < abs(now - prev - after) THEN prev ELSE now END AS time,
  sqrt((px1 - px2 + (vx1 - vx2) * after) ** 2 + (py1 - py2 + (vy1 - vy2) * after) ** 2) AS distance, CAST(abs(px1 + vx1 * after + px2 + vx2 * after) / 2 AS FLOAT) AS x, CAST(abs(py1 + vy1 * after + py2 + vy2 * after) / 2 AS FLOAT) AS y FROM ca
  WHERE sqrt((px1 - px2 + (vx1 - vx2) * after) ** 2 + (py1 - py2 + (vy1 - vy2) * after) ** 2) <= {reach:.0f}e0)"""


def encounter(spark: SparkSession, d: str, step: float = STEP, n: int = EPOCHS, reach: float = REACH) -> DataFrame:
    return encounters.met(segments(spark, d, step, n), reach, step)


def encounter_sql(step: float = STEP, n: int = EPOCHS, reach: float = REACH) -> str:
    return f"""{contact_sql(step, n, reach)},
isl AS (SELECT *, epoch - row_number() OVER (PARTITION BY node1, node2 ORDER BY epoch) AS island FROM contact),
enc AS (SELECT node1, node2, arg_min(time, epoch) AS time, greatest(arg_max(time, epoch) - arg_min(time, epoch), {step:.0f}e0) AS duration, arg_min(x, epoch) AS x, arg_min(y, epoch) AS y FROM isl GROUP BY node1, node2, island)"""


#: Encounters of one unit and one day, for the workloads.
FEW = {"step": DAY, "n": 30, "reach": 1.0}


def births(spark: SparkSession, d: str) -> DataFrame:
    return contacts.first_contacts(segments(spark, d, FEW["step"], FEW["n"]), FEW["reach"])


BIRTHS = f"{encounter_sql(**FEW)}, births AS (SELECT node, min(time) AS birth FROM (SELECT node1 AS node, time FROM enc UNION ALL SELECT node2, time FROM enc) GROUP BY node)"


def transfers(spark: SparkSession, d: str) -> DataFrame:
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_orderpriority").alias("experiment_name"), F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("sender_node"), F.col("l_partkey").alias("reciever_node"), seconds("o_orderdate").alias("creation_time"), seconds("l_shipdate").alias("transfer_time"), F.col("l_linenumber").alias("hops"), F.col("l_quantity").alias("size"))


TRANSFERS = "transfers AS (SELECT o_orderpriority AS experiment_name, l_orderkey AS message_id, l_suppkey AS sender_node, l_partkey AS reciever_node, epoch_us(o_orderdate) / 1e6 AS creation_time, epoch_us(l_shipdate) / 1e6 AS transfer_time, l_linenumber AS hops, l_quantity AS size FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def delivered(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_delivery(transfers(spark, d))


DELIVERED = f"{TRANSFERS}, delivered AS (SELECT experiment_name, message_id, sender_node, reciever_node, creation_time, transfer_time AS deliver_time, hops, size FROM transfers QUALIFY row_number() OVER (PARTITION BY experiment_name, message_id ORDER BY transfer_time, sender_node, reciever_node, hops) = 1)"


def bandwidths(spark: SparkSession, d: str) -> DataFrame:
    """Transfers of an experiment by day."""
    day = F.floor(F.col("transfer_time") / DAY)
    return transfers(spark, d).groupBy("experiment_name", day.cast("double").alias("time")).agg(F.count("*").cast("double").alias("bandwidth"))


BANDWIDTHS = f"{TRANSFERS}, bandwidths AS (SELECT experiment_name, floor(transfer_time / 86400) AS time, CAST(count(*) AS DOUBLE) AS bandwidth FROM transfers GROUP BY ALL)"


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """Copies made (+1) at a transfer and given up (-1) a week later."""
    t = transfers(spark, d)
    day = F.floor(F.col("transfer_time") / DAY)
    both = F.explode(F.array(F.struct(day.cast("double").alias("time"), F.lit(1).alias("delta")), F.struct((day + 7).cast("double").alias("time"), F.lit(-1).alias("delta"))))
    return t.select("experiment_name", "message_id", "sender_node", "hops", "size", both.alias("e")).select("experiment_name", "message_id", "sender_node", "hops", "size", "e.time", "e.delta")


DELTAS = f"{TRANSFERS}, deltas AS (SELECT experiment_name, message_id, sender_node, hops, size, floor(transfer_time / 86400) AS time, 1 AS delta FROM transfers UNION ALL SELECT experiment_name, message_id, sender_node, hops, size, floor(transfer_time / 86400) + 7, -1 FROM transfers)"

#: District centres on the range of the positions (a bounded list).
CENTRES = [(float(x), float(y), 0.0) for x in (5, 20, 50, 120) for y in (10, 50, 90)]
_CENTRES_SQL = ", ".join(f"({i}, {x:.0f}e0, {y:.0f}e0)" for i, (x, y, _) in enumerate(CENTRES))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return mobility.nearest(traj(spark, d), CENTRES)


PLACED = f"{TRAJ}, centres(district, cx, cy) AS (VALUES {_CENTRES_SQL}), placed AS (SELECT node, t, x, y, arg_min(district, ((x - cx) ** 2 + (y - cy) ** 2, district)) AS district FROM traj, centres GROUP BY node, t, x, y)"

TOP_K = 4


def top(spark: SparkSession, d: str, k: int = TOP_K) -> DataFrame:
    return mobility.top_districts(mobility.visits(placed(spark, d)), k)


TOP = f"{PLACED}, visits AS (SELECT node, district, count(*) AS visits FROM placed GROUP BY node, district), top AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY visits DESC, district) AS rank FROM visits QUALIFY rank <= {TOP_K})"
EDGES = f"{TOP}, edges AS (SELECT a.node, a.district AS d1, b.district AS d2 FROM top a JOIN top b ON a.node = b.node AND a.district < b.district)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return mobility.graph_edges(top(spark, d))


#: Side of a profile's cells, and the scale of distances between them.
SIDE, SCALE = 20.0, 20.0


def cells(spark: SparkSession, d: str) -> DataFrame:
    return profiles.cell_visits(traj(spark, d), SIDE)


CELLS = f"{TRAJ}, box AS (SELECT min(x) AS mx, min(y) AS my FROM traj), cells AS (SELECT node, CAST(floor((x - mx) / {SIDE:.0f}e0) AS BIGINT) AS cx, CAST(floor((y - my) / {SIDE:.0f}e0) AS BIGINT) AS cy, CAST(0 AS BIGINT) AS cz, count(*) AS visits, max(t) AS reached FROM traj, box GROUP BY ALL)"
GENERAL = f"{CELLS}, gen AS (SELECT cx, cy, cz, sum(visits) / (SELECT sum(visits) FROM cells)::DOUBLE AS score FROM cells GROUP BY cx, cy, cz), gsim AS (SELECT a.cx, a.cy, a.cz, sum(CASE WHEN a.cx = b.cx AND a.cy = b.cy THEN b.score ELSE b.score / (sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) * {SCALE:.0f}e0) END) AS general FROM gen a, gen b GROUP BY ALL)"
OWN = f"{GENERAL}, own AS (SELECT node, cx, cy, cz, visits / sum(visits) OVER (PARTITION BY node)::DOUBLE AS score FROM cells), nsim AS (SELECT a.node, a.cx, a.cy, a.cz, sum(CASE WHEN a.cx = b.cx AND a.cy = b.cy THEN b.score ELSE b.score / (sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) * {SCALE:.0f}e0) END) AS similarity FROM own a JOIN own b ON a.node = b.node GROUP BY ALL), marg AS (SELECT nsim.*, general, similarity / nullif(general, 0) AS marginal FROM nsim JOIN gsim USING (cx, cy, cz))"


def hash_sql(seed: int, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8) AS BIGINT)"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"({hash_sql(seed, *keys)} / 4294967296e0)"


def workload(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A message from each node, and the encounters of FEW."""
    met = checkpointed(encounter(spark, d, **FEW))
    pairs = generate.direct_messages(encounters.births(met), 5)
    messages = generate.with_template(pairs, {"ttl_hops": 20, "ttl_time": 40 * 86400, "payload": "x"}, 5)
    return messages, met
