"""Experiments end to end: import a dataset, build encounters and messages, replay a policy, store its results.

A store is a folder of Parquet relations partitioned by dataset or experiment. Keys of the settings are those of the JSON
files: Settings for a simulation, Logic for a policy.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import contacts, encounters, epochs, generate, metrics, mobility, profiles, routing
from wayfare.sources import readers, sinks


@dataclass
class Settings:
    experiment_name: str
    dataset_name: str
    start_time: float = 1200000000.0
    end_time: float = 1340000000.0
    logic: str = "broadcast"
    message_generation_type: int = 1
    min_buffer_size: int = 50
    max_buffer_size: int = 50
    min_message_size: float = 1.0
    max_message_size: float = 1.0
    time_step: float = 60.0
    N_encounters_split: int = 2
    seed: int = 12345


@dataclass
class Logic:
    randomwalk_transfer_probability: float = 0.5
    randomwalk_delete_probability: float = 1.0
    randomwalk_transfer_constant: float = 1000.0
    mixed_randomwalk_version: int = 1
    ideality_coin_flip: float = 0.5
    organizer: int = 1
    remove_delivered_messages: bool = False
    districts_amount: int = 100
    p: float = 0.6
    k: int = 4
    kmeans_iterations: int = 50
    max_n: int = 10
    n_factor: int = 1
    noise_sigma: float = 0.0
    attack_type: str = ""
    gridsize: float = 200.0
    distance: float = 20.0


def read_settings(cls, text: str):
    """Settings or Logic from a JSON object; a nested `simulation` object is taken if it is there; other keys are ignored."""
    found = json.loads(text)
    found = found.get("simulation", found)
    names = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in found.items() if k in names})


def import_dataset(spark: SparkSession, root: str, kind: str, path: str, dataset: str) -> DataFrame:
    """Reads traces into events and node_lists, and marks the dataset as complete."""
    sinks.store(readers.import_traces(spark, kind, path, dataset), root, "events", "dataset_name")
    events = readers.table(spark, root, "events", dataset)
    sinks.store(events.select("dataset_name", "node").distinct(), root, "node_lists", "dataset_name")
    sinks.store(spark.range(1).select(F.lit(dataset).alias("dataset_name"), F.current_timestamp().alias("date_imported"), F.lit(True).alias("complete_import")), root, "datasets", "dataset_name")
    return events


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    return readers.table(spark, root, "datasets").where("complete_import")


def positions(spark: SparkSession, root: str, s: Settings) -> DataFrame:
    """Events of the range, with times counted from its start."""
    e = readers.table(spark, root, "events", s.dataset_name).where(F.col("time").between(s.start_time, s.end_time))
    return e.select("node", (F.col("time") - s.start_time).alias("t"), "x", "y", "z")


def build_encounters(spark: SparkSession, root: str, s: Settings, conditions: dict, cell: float | None = None) -> DataFrame:
    """Encounters of the range under the conditions, built once for the same parameters."""
    found, _ = contacts.read_conditions(conditions)
    reach = min([c.dist for c in found if c.type == "distance"], default=None)
    if reach is None:
        raise ValueError("a distance condition is needed")

    def build() -> DataFrame:
        n = int((s.end_time - s.start_time) // s.time_step)
        near = contacts.contacts(epochs.segments(positions(spark, root, s), s.time_step, n), reach, cell)
        return encounters.merge(contacts.meeting(near, found, s.seed), s.time_step)

    key = {"dataset": s.dataset_name, "start": s.start_time, "end": s.end_time, "step": s.time_step, "conditions": conditions, "seed": s.seed}
    return encounters.cached(spark, root, key, build)


def build_messages(met: DataFrame, s: Settings, template: dict) -> DataFrame:
    """Messages of generation type 0 (direct), 1 (group), 2 (bulk), 3 (gradual) or 4 (half-gradual)."""
    born, end = encounters.births(met), s.end_time - s.start_time
    makers = {
        0: lambda: generate.direct_messages(born, s.seed), 1: lambda: generate.group_messages(born), 2: lambda: generate.bulk_messages(born, s.seed),
        3: lambda: generate.bulk_messages(born, s.seed, end=end), 4: lambda: generate.bulk_messages(born, s.seed, end=end, share=0.5),
    }
    if s.message_generation_type not in makers:
        raise ValueError(f"unknown message generation type {s.message_generation_type}")
    return generate.with_template(makers[s.message_generation_type](), template | {"min_size": s.min_message_size, "max_size": s.max_message_size}, s.seed)


def policy_of(spark: SparkSession, root: str, s: Settings, logic: Logic) -> routing.Policy:
    """The policy a name stands for, with what it learns from the dataset's events."""
    walk = routing.RandomWalk(logic.randomwalk_transfer_probability, logic.randomwalk_delete_probability)
    aged = routing.AgedWalk(delete=logic.randomwalk_delete_probability, constant=logic.randomwalk_transfer_constant)
    simple = {"broadcast": routing.Broadcast(drop_delivered=logic.remove_delivered_messages), "randomwalk-v1": walk, "randomwalk-v2": aged, "mixed": routing.Mixed(walk if logic.mixed_randomwalk_version == 1 else aged, logic.ideality_coin_flip, s.seed)}
    if s.logic in simple:
        return simple[s.logic]
    events, span = positions(spark, root, s), s.end_time - s.start_time
    if s.logic == "mirage":
        parts = profiles.time_split(events, 0.0, span)
        centres = mobility.districts(parts.where("part = 1"), logic.districts_amount, logic.kmeans_iterations, s.seed)
        top = mobility.top_districts(mobility.visits(mobility.nearest(parts.where("part = 2"), centres)), logic.k)
        edges = mobility.graph_edges(top)
        weights = mobility.graph_weights(edges)
        if logic.attack_type:
            weights = mobility.attacked(weights, logic.attack_type, logic.noise_sigma, s.seed)
        graphs: dict[int, set] = {}
        for r in mobility.randomised(edges, top.select("node").distinct(), len(centres), logic.p, s.seed).collect():
            graphs.setdefault(r["node"], set()).add((r["d1"], r["d2"]))
        home = {r["node"]: r["district"] for r in top.where("rank = 1").collect()}
        return routing.Mirage(centres, graphs, home, {(r["d1"], r["d2"]): r["weight"] for r in weights.collect()}, logic.p, logic.n_factor, logic.max_n, s.seed)
    if s.logic in ("addressing", "ppbr"):
        cells = profiles.cell_visits(profiles.head_split(events).where("in_profile"), logic.distance)
        home = profiles.popular_cell(cells).select(F.col("node").alias("destination"), *profiles.CELL)
        asked = cells.select("node").distinct().join(home.select(*profiles.CELL).distinct())
        ok = profiles.accepted(asked, cells, logic.gridsize).where("accepted").join(home, profiles.CELL)
        return routing.Profiled({(r[0], r[1]) for r in ok.select("node", "destination").collect()})
    raise ValueError(f"unknown logic {s.logic!r}")


def simulate(spark: SparkSession, root: str, s: Settings, logic: Logic, conditions: dict, template: dict) -> DataFrame:
    """Runs an experiment and stores message_dbs, delivered_message_dbs, bandwidths, epoch_loads and results_dbs; its results row."""
    met = build_encounters(spark, root, s, conditions)
    messages = build_messages(met, s, template)
    pieces = encounters.split(met, s.N_encounters_split * 10 * s.time_step)
    capacity = float(s.max_buffer_size) if logic.organizer == 1 else None
    events = routing.replay(messages, pieces, policy_of(spark, root, s, logic), s.experiment_name, capacity, seed=s.seed)
    sinks.store(events, root, "exchange_events", "experiment_name")
    done = spark.read.parquet(f"{root}/exchange_events").where(F.col("experiment_name") == s.experiment_name)
    sent = done.where("kind = 'transfer'").withColumnRenamed("time", "transfer_time").drop("kind", "bandwidth", "drops")
    got = done.where("kind = 'delivery'").withColumnRenamed("time", "deliver_time").drop("kind", "bandwidth", "drops")
    band = done.where("kind = 'load'").select("experiment_name", "time", F.col("sender_node").alias("node1"), F.col("reciever_node").alias("node2"), "bandwidth", "drops")
    delta = F.when(F.col("kind").isin("originate", "transfer"), 1).when(F.col("kind").isin("drop", "handoff", "expired"), -1)
    loads = metrics.epoch_loads(done.withColumn("delta", delta).where("delta is not null").select("experiment_name", "time", "message_id", "delta"))
    for df, name in ((sent, "message_dbs"), (got, "delivered_message_dbs"), (band, "bandwidths"), (loads, "epoch_loads")):
        sinks.store(df, root, name, "experiment_name")
    count = messages.groupBy(F.lit(s.experiment_name).alias("experiment_name")).agg(F.count("*").alias("num_messages"))
    one = count.join(metrics.latency(got), "experiment_name", "left").join(metrics.load(band), "experiment_name", "left").join(metrics.throughput(got, count), "experiment_name", "left").join(metrics.load_summary(loads), "experiment_name", "left")
    sinks.store(one, root, "results_dbs", "experiment_name")
    family = spark.range(1).select(F.lit(s.dataset_name).alias("family_dataset"), F.lit(s.logic).alias("logic"), F.lit(s.experiment_name).alias("experiment_name"))
    sinks.store(family, root, "experiment_families", "experiment_name")
    return spark.read.parquet(f"{root}/results_dbs").where(F.col("experiment_name") == s.experiment_name)


def family_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of all experiments with the family each belongs to."""
    return spark.read.parquet(f"{root}/experiment_families").join(spark.read.parquet(f"{root}/results_dbs"), "experiment_name")


def dataset_of(experiments: DataFrame) -> DataFrame:
    """(dataset_name, experiment_name): the experiment of each dataset that was started last."""
    return experiments.groupBy("dataset_name").agg(F.max_by("experiment_name", F.struct("date_started", "experiment_name")).alias("experiment_name"))
