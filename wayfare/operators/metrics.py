"""Delivery, latency and load of experiments, from transfers, deliveries and per-encounter loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_delivery(transfers: DataFrame) -> DataFrame:
    """The first transfer of each message of an experiment, by time, then sender and receiver."""
    w = Window.partitionBy("experiment_name", "message_id").orderBy("transfer_time", "sender_node", "reciever_node", "hops")
    return transfers.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").withColumnRenamed("transfer_time", "deliver_time")


def latency(delivered: DataFrame) -> DataFrame:
    return delivered.groupBy("experiment_name").agg(F.avg(F.col("deliver_time") - F.col("creation_time")).alias("lat_sec"), F.avg("hops").alias("lat_hop"))


def load(bandwidths: DataFrame) -> DataFrame:
    return bandwidths.groupBy("experiment_name").agg(F.max("bandwidth").alias("max_band"), F.sum("bandwidth").cast("long").alias("net_load"))


def throughput(delivered: DataFrame, n_messages: DataFrame) -> DataFrame:
    """Deliveries over messages; n_messages: (experiment_name, num_messages). Null without messages."""
    return n_messages.join(delivered.groupBy("experiment_name").agg(F.count("*").alias("delivered")), "experiment_name", "left").select("experiment_name", F.try_divide(F.coalesce("delivered", F.lit(0)), F.col("num_messages")).alias("throughput"))


def delivery_rate(transfers: DataFrame, delivered: DataFrame) -> DataFrame:
    """Deliveries x 100 div distinct messages transferred, as an integer."""
    sent = transfers.groupBy("experiment_name").agg(F.count_distinct("message_id").alias("sent"))
    got = delivered.groupBy("experiment_name").agg(F.count("*").alias("delivered"))
    return sent.join(got, "experiment_name", "left").select("experiment_name", "sent", F.coalesce("delivered", F.lit(0)).alias("delivered"), F.expr("coalesce(delivered, 0) * 100 div sent").alias("rate"))


def epoch_loads(deltas: DataFrame) -> DataFrame:
    """(experiment_name, now, prev, load, avg_load) from copy changes (experiment_name, time, message_id, delta).

    load: copies that exist before the changes at now; avg_load: that over the messages with a change so far.
    """
    first = deltas.groupBy("experiment_name", "message_id").agg(F.min("time").alias("time")).groupBy("experiment_name", "time").agg(F.count("*").alias("fresh"))
    per = deltas.groupBy("experiment_name", "time").agg(F.sum("delta").alias("delta")).join(first, ["experiment_name", "time"], "left")
    w = Window.partitionBy("experiment_name").orderBy("time")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    load, fresh = F.coalesce(F.sum("delta").over(before), F.lit(0)), F.coalesce(F.sum(F.coalesce("fresh", F.lit(0))).over(before), F.lit(0))
    return per.select("experiment_name", F.col("time").alias("now"), F.lag("time").over(w).alias("prev"), load.alias("load"), F.coalesce(F.try_divide(load, fresh), F.lit(0.0)).alias("avg_load"))


def load_summary(loads: DataFrame) -> DataFrame:
    return loads.groupBy("experiment_name").agg(F.greatest(F.max("avg_load"), F.lit(0.0)).alias("peak_load"), F.avg("avg_load").alias("average_load"))


def buffer_maxes(deltas: DataFrame) -> DataFrame:
    """(experiment_name, node, max): greatest running use of each node's buffer, from changes (experiment_name, node, time, seq, change)."""
    w = Window.partitionBy("experiment_name", "node").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("use", F.sum("change").over(w)).groupBy("experiment_name", "node").agg(F.max("use").alias("max"))


def fullest_node(maxes: DataFrame) -> DataFrame:
    return maxes.groupBy("experiment_name").agg(F.max("max").alias("max"), (-F.max_by(-F.col("node"), F.struct("max", -F.col("node")))).alias("node"))


def average_copies(deltas: DataFrame) -> DataFrame:
    """Copies that are left, a message."""
    return deltas.groupBy("experiment_name", "message_id").agg(F.sum("delta").alias("copies")).groupBy("experiment_name").agg(F.avg("copies").alias("avg_copies"))


def new_deliveries(candidates: DataFrame, delivered: DataFrame) -> DataFrame:
    """Candidate deliveries of messages that aren't delivered yet."""
    return candidates.join(delivered.select("experiment_name", "message_id").distinct(), ["experiment_name", "message_id"], "left_anti")
