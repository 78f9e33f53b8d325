"""Queries that write the events in a trace format, read the files back and return what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.plans import adapters as a
from wayfare.plans.registry import ORACLE_SQL, QUERIES, query
from wayfare.plans.trajectories import _A, _E2, _N
from wayfare.sources import readers, stored, writers
from wayfare.sources.sinks import shared_dir

#: Formats whose files Spark's writers can make.
KINDS = ["tdrive", "cabspotting", "cabspotting2d", "hand", "hamburg", "napa", "kalmaegi", "wipha", "rammasun", "halong", "mdc", "randomwalk"]


def _rows(spark, d) -> DataFrame:
    """Events as places of four decimals, at whole seconds."""
    value, k = F.floor(F.col("value") * 100).cast("long"), F.get_json_object("props", "$.k").cast("long")
    degrees = lambda v: (v / F.lit(10000.0)).cast("decimal(10,4)")
    return a.read(spark, d, "events").select(F.col("user_id").alias("node"), F.floor(a.seconds("ts")).cast("double").alias("time"), degrees(value - 300000).alias("lat"), degrees(k * 10001).alias("lon"), degrees(value).alias("alt"), F.col("event_id").alias("nth"))


def _read_back(spark, d, kind: str) -> DataFrame:
    path = f"{shared_dir(spark)}/traces-{kind}-{uuid.uuid4().hex}"
    writers.write_traces(_rows(spark, d), kind, path)
    read = readers.import_traces(spark, kind, path, kind)
    return read.select("dataset_name", F.round("time", 3).alias("time"), "node", *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in "xyz"])


def _sql(kind: str) -> str:
    form = readers.FORMATS[kind]
    order = "CAST(node AS VARCHAR) || '/'" if form.node == "" else "CAST(node AS VARCHAR)"
    node = f"dense_rank() OVER (ORDER BY {order}) - 1" if form.node == "" or isinstance(form.node, str) or form.squeeze else "node"
    alt = "alt" if form.alt is not None else "0e0"
    flat = f"{_A} * radians(lon) AS x, {_A} * ln(tan(pi() / 4 + radians(lat) / 2)) AS y, 0e0 AS z"
    n = _N.replace("y - 45", "lat")
    globe = f"({n} + {alt}) * cos(radians(lat)) * cos(radians(lon)) AS x, ({n} + {alt}) * cos(radians(lat)) * sin(radians(lon)) AS y, ({n} * (1 - {_E2}) + {alt}) * sin(radians(lat)) AS z"
    return f"""WITH e AS (SELECT user_id AS node, floor(epoch_us(ts) / 1e6) AS time, CAST(floor(value * 100) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id AS nth FROM events),
p AS (SELECT node, time, nth, (v - 300000) / 10000e0 AS lat, (k * 10001) / 10000e0 AS lon, v / 10000e0 AS alt FROM e),
first AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY node, time ORDER BY nth) = 1),
placed AS (SELECT {node} AS node, time, {flat if form.flat else globe} FROM first)
SELECT '{kind}' AS dataset_name, round(time, 3) AS time, node, round(x, 2) + 0e0 AS x, round(y, 2) + 0e0 AS y, round(z, 2) + 0e0 AS z FROM placed"""


for _kind in KINDS:
    QUERIES[f"read_{_kind}"] = lambda spark, d, kind=_kind: _read_back(spark, d, kind)
    ORACLE_SQL[f"read_{_kind}"] = _sql(_kind)


@query("""WITH e AS (SELECT user_id AS node, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS d, CAST(floor((epoch_us(ts) / 1e6 % 86400) / 1800) AS BIGINT) AS t, CAST(floor(value) AS BIGINT) AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) AS y, event_id AS nth FROM events)
SELECT 'japan' AS dataset_name, 1704067200e0 + d * 86400 + t * 1800 AS time, node, x * 500e0 AS x, y * 500e0 AS y, 0e0 AS z FROM e QUALIFY row_number() OVER (PARTITION BY node, d, t ORDER BY nth) = 1""")
def read_japan(spark, d):
    """Cell traces: a node's first cell of each half hour."""
    s = a.seconds("ts")
    day = F.floor((s - F.lit(1704067200.0)) / a.DAY).cast("long")
    rows = a.read(spark, d, "events").select(F.col("user_id").alias("node"), day.alias("d"), F.floor(F.pmod(s, F.lit(a.DAY)) / 1800).cast("long").alias("t"), F.floor("value").cast("long").alias("x"), F.get_json_object("props", "$.k").cast("long").alias("y"), F.col("event_id").alias("nth"))
    path = f"{shared_dir(spark)}/traces-japan-{uuid.uuid4().hex}"
    writers.write_traces(rows, "japan", path)
    return readers.import_traces(spark, "japan", path, "japan")


@query("""WITH u AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, 2 * o_totalprice AS o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT -o_orderkey - 1, o_custkey, 'N', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM u UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL""")
def merged_orders(spark, d):
    """Orders as a stored relation, of which the finished ones are replaced and urgent ones added under new keys, each update
    twice."""
    o = a.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    root = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    stored.merge(o, root, "orders", ["o_orderkey"])
    closed = o.where("o_orderstatus = 'F'").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": 2 * F.col("o_totalprice")})
    urgent = a.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice")
    both = closed.unionByName(urgent)
    stored.merge(both.unionByName(both.withColumn("o_totalprice", F.lit(-1.0))), root, "orders", ["o_orderkey"], F.col("o_totalprice"))
    return stored.read(spark, root, "orders").withColumn("o_totalprice", F.round("o_totalprice", 2))
