"""Queries over transfers, deliveries, loads and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import rng, scalars
from wayfare.operators import metrics, reports, routing
from wayfare.plans import adapters as a
from wayfare.plans.registry import query
from wayfare.plans.trajectories import r


@query(f"WITH {a.DELIVERED} SELECT experiment_name, message_id, sender_node, reciever_node, round(deliver_time, 4) AS deliver_time, hops FROM delivered")
def first_delivery(spark, d):
    return a.delivered(spark, d).select("experiment_name", "message_id", "sender_node", "reciever_node", r("deliver_time"), "hops")


@query(f"WITH {a.TRANSFERS} SELECT experiment_name, sender_node, count(reciever_node) AS sent FROM transfers GROUP BY ALL")
def sent_per_node(spark, d):
    return reports.sent_per_node(a.transfers(spark, d))


@query(f"WITH {a.TRANSFERS} SELECT experiment_name, reciever_node, count(sender_node) AS received FROM transfers GROUP BY ALL")
def received_per_node(spark, d):
    return reports.received_per_node(a.transfers(spark, d))


@query(f"WITH {a.DELIVERED} SELECT experiment_name, round(avg(deliver_time - creation_time), 4) AS lat_sec, round(avg(hops), 4) AS lat_hop FROM delivered GROUP BY ALL")
def latency_hops(spark, d):
    return metrics.latency(a.delivered(spark, d)).select("experiment_name", r("lat_sec"), r("lat_hop"))


@query(f"WITH {a.BANDWIDTHS} SELECT experiment_name, round(max(bandwidth), 4) AS max_band, CAST(sum(bandwidth) AS BIGINT) AS net_load FROM bandwidths GROUP BY ALL")
def network_load(spark, d):
    return metrics.load(a.bandwidths(spark, d)).select("experiment_name", r("max_band"), "net_load")


_N_MESSAGES = "n AS (SELECT o_orderpriority AS experiment_name, count(*) AS num_messages FROM orders GROUP BY ALL)"


@query(f"WITH {a.DELIVERED}, {_N_MESSAGES} SELECT experiment_name, round(coalesce(c, 0) / num_messages, 6) AS throughput FROM n LEFT JOIN (SELECT experiment_name, count(*)::DOUBLE AS c FROM delivered GROUP BY ALL) USING (experiment_name)")
def throughput(spark, d):
    n = a.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("experiment_name")).agg(F.count("*").alias("num_messages"))
    return metrics.throughput(a.delivered(spark, d), n).select("experiment_name", r("throughput", 6))


@query(f"WITH {a.TRANSFERS} SELECT experiment_name, count(*) AS messages FROM (SELECT DISTINCT experiment_name, message_id FROM transfers WHERE sender_node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) GROUP BY ALL")
def messages_of_regular_nodes(spark, d):
    regular = a.read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sender_node"))
    return a.transfers(spark, d).join(regular, "sender_node", "left_semi").select("experiment_name", "message_id").distinct().groupBy("experiment_name").agg(F.count("*").alias("messages"))


@query(f"WITH {a.DELIVERED}, s AS (SELECT experiment_name, count(DISTINCT message_id) AS sent FROM transfers GROUP BY ALL), g AS (SELECT experiment_name, count(*) AS delivered FROM delivered WHERE hops = 1 GROUP BY ALL) SELECT experiment_name, sent, coalesce(delivered, 0) AS delivered, CAST(coalesce(delivered, 0) * 100 // sent AS BIGINT) AS rate FROM s LEFT JOIN g USING (experiment_name)")
def delivery_rate(spark, d):
    return metrics.delivery_rate(a.transfers(spark, d), a.delivered(spark, d).where("hops = 1"))


@query(f"WITH {a.TRANSFERS} SELECT experiment_name, count(DISTINCT message_id) AS messages, count(DISTINCT sender_node) AS senders, count(DISTINCT CASE WHEN hops > 3 THEN message_id END) AS far FROM transfers GROUP BY ALL")
def distinct_messages(spark, d):
    return a.transfers(spark, d).groupBy("experiment_name").agg(F.count_distinct("message_id").alias("messages"), F.count_distinct("sender_node").alias("senders"), F.count_distinct(F.when(F.col("hops") > 3, F.col("message_id"))).alias("far"))


_LOADS = f"""{a.DELTAS}, f AS (SELECT experiment_name, time, count(*) AS fresh FROM (SELECT experiment_name, message_id, min(time) AS time FROM deltas GROUP BY ALL) GROUP BY ALL),
p AS (SELECT experiment_name, time, sum(delta) AS delta FROM deltas GROUP BY ALL), l AS (SELECT p.experiment_name, time AS now, lag(time) OVER w AS prev, coalesce(sum(delta) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS load,
  coalesce(sum(coalesce(fresh, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM p LEFT JOIN f USING (experiment_name, time) WINDOW w AS (PARTITION BY p.experiment_name ORDER BY time)),
loads AS (SELECT experiment_name, now, prev, CAST(load AS BIGINT) AS load, coalesce(load / nullif(seen, 0)::DOUBLE, 0e0) AS avg_load FROM l)"""


@query(f"WITH {_LOADS} SELECT experiment_name, now, prev, load, round(avg_load, 6) AS avg_load FROM loads")
def epoch_load(spark, d):
    return metrics.epoch_loads(a.deltas(spark, d)).select("experiment_name", "now", "prev", "load", r("avg_load", 6))


@query(f"WITH {_LOADS} SELECT experiment_name, round(greatest(max(avg_load), 0), 6) AS peak_load, round(avg(avg_load), 6) AS average_load FROM loads GROUP BY ALL")
def peak_and_average_load(spark, d):
    return metrics.load_summary(metrics.epoch_loads(a.deltas(spark, d))).select("experiment_name", r("peak_load", 6), r("average_load", 6))


_BUFFERS = f"{a.DELTAS}, u AS (SELECT experiment_name, sender_node AS node, sum(size * delta) OVER (PARTITION BY experiment_name, sender_node ORDER BY time, message_id, hops, delta ROWS UNBOUNDED PRECEDING) AS use FROM deltas), m AS (SELECT experiment_name, node, max(use) AS max FROM u GROUP BY ALL)"


def _buffers(spark, d):
    return metrics.buffer_maxes(a.deltas(spark, d).select("experiment_name", F.col("sender_node").alias("node"), "time", F.struct("message_id", "hops", "delta").alias("seq"), (F.col("size") * F.col("delta")).alias("change")))


@query(f"WITH {_BUFFERS} SELECT experiment_name, node, round(max, 4) AS max FROM m")
def buffer_maxes(spark, d):
    return _buffers(spark, d).select("experiment_name", "node", r("max"))


@query(f"WITH {_BUFFERS} SELECT experiment_name, round(max(max), 4) AS max, arg_max(node, (max, -node)) AS node FROM m GROUP BY ALL")
def fullest_buffer(spark, d):
    return metrics.fullest_node(_buffers(spark, d)).select("experiment_name", r("max"), "node")


@query(f"WITH {a.TRANSFERS} SELECT experiment_name, round(avg(n), 6) AS avg_copies FROM (SELECT experiment_name, message_id, count(*) AS n FROM transfers GROUP BY ALL) GROUP BY ALL")
def average_copies(spark, d):
    return metrics.average_copies(a.transfers(spark, d).withColumn("delta", F.lit(1))).select("experiment_name", r("avg_copies", 6))


_LATENCY = "deliver_time - creation_time"


@query(f"""WITH {a.DELIVERED}, l AS (SELECT experiment_name, min({_LATENCY}) AS low, max({_LATENCY}) AS high FROM delivered GROUP BY ALL),
c AS (SELECT experiment_name, least(CAST(floor(({_LATENCY} - low) / ((high - low) / 10)) AS INT), 9) AS bucket, count(*) AS count FROM delivered JOIN l USING (experiment_name) GROUP BY ALL)
SELECT g.experiment_name, g.bucket, coalesce(count, 0) AS count FROM (SELECT experiment_name, CAST(i AS INT) AS bucket FROM l, range(10) AS x(i)) g LEFT JOIN c ON c.experiment_name = g.experiment_name AND c.bucket = g.bucket""")
def transfer_histogram(spark, d):
    return reports.histogram10(a.delivered(spark, d), F.col("deliver_time") - F.col("creation_time"), ["experiment_name"]).select("experiment_name", "bucket", "count")


@query(f"WITH {a.TRANSFERS}, c AS (SELECT CASE WHEN transfer_time = 820454400 + 604800 * 52 THEN 51 ELSE CAST(floor((transfer_time - 820454400) / 604800) AS INT) END AS bin, count(*) AS count FROM transfers WHERE transfer_time BETWEEN 820454400 AND 820454400 + 604800 * 52 GROUP BY 1) SELECT CAST(i AS INT) AS bin, coalesce(count, 0) AS count FROM range(52) AS g(i) LEFT JOIN c ON bin = i")
def day_bins(spark, d):
    return reports.day_bins(a.transfers(spark, d), F.col("transfer_time"), 820454400.0, 7, 52)


@query(f"WITH {a.BANDWIDTHS} SELECT experiment_name, round(quantile_cont(bandwidth, 0.25), 6) AS p25, round(quantile_cont(bandwidth, 0.5), 6) AS median, round(quantile_cont(bandwidth, 0.75), 6) AS p75 FROM bandwidths GROUP BY ALL")
def metric_quartiles(spark, d):
    return reports.quartiles(a.bandwidths(spark, d), "bandwidth", ["experiment_name"]).select("experiment_name", r("p25", 6), r("median", 6), r("p75", 6))


@query("""WITH g AS (SELECT (CASE WHEN o_orderkey % 5 = 0 THEN 'flood' ELSE 'mirage' END) || '_k=' || (2 + o_orderkey % 4) || '_p=0.' || (55 + o_custkey % 40) AS name, (2 + o_orderkey % 4) AS k, (55 + o_custkey % 40) AS c, o_totalprice FROM orders)
SELECT name, CAST(k AS VARCHAR) AS k, '0.' || c AS p, count(*) AS runs, round(k * (k - 1) * ln((c / 100e0) / (1 - c / 100e0)), 6) AS epsilon, round(max(o_totalprice) / avg(o_totalprice), 6) AS peak_to_average FROM g WHERE name LIKE 'mirage%' GROUP BY name, k, c""")
def sweep_names(spark, d):
    """Orders as runs of a sweep, named by their parameters: the names found by their beginning, the parameters read back from
    them, what each setting discloses, and the ratio of its peak load to the average."""
    o = a.read(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "flood").otherwise("mirage")
    name = F.concat(kind, F.lit("_k="), (2 + F.col("o_orderkey") % 4).cast("string"), F.lit("_p=0."), (55 + F.col("o_custkey") % 40).cast("string"))
    runs = o.select(name.alias("name"), "o_totalprice").where(F.col("name").like("mirage%"))
    found = runs.groupBy("name").agg(F.count("*").alias("runs"), F.round(reports.peak_to_average(F.col("o_totalprice")), 6).alias("peak_to_average"))
    read = found.select("name", scalars.name_parameter(F.col("name"), "k").alias("k"), scalars.name_parameter(F.col("name"), "p").alias("p"), "runs", "peak_to_average")
    return read.withColumn("epsilon", F.round(reports.epsilon(F.col("k").cast("double"), F.col("p").cast("double")), 6))


@query(f"WITH {a.DELIVERED}, m AS (SELECT experiment_name, count(*) AS n, round(avg(hops), 6) AS hops FROM delivered GROUP BY ALL) SELECT substr(experiment_name, 1, 1) AS family, count(*) AS members, CAST(sum(n) AS BIGINT) AS delivered, round(avg(hops), 4) AS hops FROM m GROUP BY 1")
def family_metrics(spark, d):
    """Experiments joined to their families, and the families' results."""
    res = a.delivered(spark, d).groupBy("experiment_name").agg(F.count("*").alias("n"), F.round(F.avg("hops"), 6).alias("hops"))
    families = a.read(spark, d, "orders").select(F.col("o_orderpriority").alias("experiment_name")).distinct().withColumn("family", F.substring("experiment_name", 1, 1))
    return families.join(res, "experiment_name").groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("delivered"), F.round(F.avg("hops"), 4).alias("hops"))


@query(f"WITH {a.TRANSFERS}, p AS (SELECT message_id, string_agg(reciever_node || ':' || CAST(CAST(transfer_time AS BIGINT) AS VARCHAR) || ',', '' ORDER BY transfer_time, reciever_node, hops) AS path FROM transfers GROUP BY message_id) SELECT message_id, path FROM p")
def path_string(spark, d):
    hop = F.struct("transfer_time", "reciever_node", "hops")
    t = a.transfers(spark, d).groupBy("message_id").agg(F.array_sort(F.collect_list(hop)).alias("l"))
    path = F.transform("l", lambda h: F.struct(h["reciever_node"].alias("node"), h["transfer_time"].cast("long").alias("time")))
    return t.select("message_id", scalars.path_string(path).alias("path"))


@query(f"WITH {a.TRANSFERS} SELECT reciever_node AS node, count(*) AS n, sha256(string_agg(DISTINCT CAST(message_id AS VARCHAR), '' ORDER BY CAST(message_id AS VARCHAR))) AS digest FROM transfers GROUP BY reciever_node")
def message_set_hash(spark, d):
    return a.transfers(spark, d).groupBy(F.col("reciever_node").alias("node")).agg(F.count("*").alias("n"), F.collect_set(F.col("message_id").cast("string")).alias("ids")).select("node", "n", scalars.message_set_hash(F.col("ids")).alias("digest"))


@query("WITH c AS (SELECT p_partkey, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY p_partkey) AS total FROM part, unnest(string_split(p_name, '')) AS u(c) GROUP BY p_partkey, c) SELECT p_partkey, round(sum(-n / total * log2(n / total)), 6) AS bits FROM c GROUP BY p_partkey")
def shannon_entropy(spark, d):
    return a.read(spark, d, "part").select("p_partkey", F.round(scalars.entropy(F.col("p_name")), 6).alias("bits"))


@query("WITH t AS (SELECT p_partkey, [10, 20, 30, 40, 0][1 + p_size % 5] AS code FROM part) SELECT p_partkey, code, CASE code WHEN 10 THEN 'unicast' WHEN 20 THEN 'multicast' WHEN 30 THEN 'broadcast' WHEN 40 THEN 'anycast' ELSE 'unknown' END AS kind FROM t")
def address_types(spark, d):
    code = F.get(F.array(*[F.lit(v) for v in (10, 20, 30, 40, 0)]), (F.col("p_size") % 5).cast("int"))
    return a.read(spark, d, "part").select("p_partkey", code.alias("code"), scalars.address_type(code).alias("kind"))


@query(f"""WITH {a.encounter_sql()}, e AS (SELECT node1, node2, round(time, 4) AS time, printf('%.6f', time) || node1 || node2 AS s FROM enc)
SELECT node1, node2, time, CAST(list_reduce([14695981039346656037::UHUGEINT] || list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS UHUGEINT)), lambda h, b: CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211 % 18446744073709551616::UHUGEINT) AS VARCHAR) AS hash FROM e""")
def encounter_hashes(spark, d):
    """FNV-1a keys of encounters."""
    return a.encounter(spark, d).select("node1", "node2", r("time"), scalars.encounter_hash(F.col("time"), F.col("node1"), F.col("node2")).alias("hash"))


@query(f"WITH {a.TRANSFERS}, s AS (SELECT DISTINCT message_id, hops - 1 AS shardid FROM transfers), g AS (SELECT message_id, string_agg('p' || shardid, '' ORDER BY shardid) AS payload, max(shardid) + 1 AS n, count(*) AS c FROM s GROUP BY message_id) SELECT CAST(message_id AS VARCHAR) AS message_id, payload FROM g WHERE n = c AND n % 2 = 0")
def reassemble_shards(spark, d):
    """Line items as shards of their order; the last one is marked in orders of an even number of them."""
    t = a.transfers(spark, d).withColumn("n", F.max("hops").over(Window.partitionBy("message_id")))
    shards = t.select(F.concat_ws("_", "message_id", (F.col("hops") - 1).cast("string")).alias("message_id"), (F.col("hops") - 1).alias("shardid"), (~((F.col("hops") == F.col("n")) & (F.col("n") % 2 == 0))).alias("ms"), F.concat(F.lit("p"), (F.col("hops") - 1).cast("string")).alias("payload"), F.col("transfer_time").alias("time"))
    return routing.reassembled(shards).select("message_id", "payload")


@query(f"WITH {a.DELIVERED}, c AS (SELECT * FROM transfers WHERE hops >= 3) SELECT experiment_name, count(*) AS fresh FROM c WHERE NOT EXISTS (SELECT 1 FROM delivered x WHERE x.hops < 3 AND x.experiment_name = c.experiment_name AND x.message_id = c.message_id) GROUP BY ALL")
def undelivered(spark, d):
    left = metrics.new_deliveries(a.transfers(spark, d).where("hops >= 3"), a.delivered(spark, d).where("hops < 3"))
    return left.groupBy("experiment_name").agg(F.count("*").alias("fresh"))


@query(f"WITH {a.TRAJ} SELECT node, round(t, 6) AS t, {a.hash_sql(9, 'node', 'CAST(floor(t) AS BIGINT)')} AS h FROM traj")
def hash_uniform(spark, d):
    return a.traj(spark, d).select("node", r("t", 6), rng.hash32(9, "node", F.floor("t", 6).cast("long")).alias("h"))
