"""The mobility engine: geometry, positions, contacts, encounters, exchange, readers, sinks and streams."""

import json
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import geo, rng, scalars
from wayfare.operators import contacts, encounters, epochs, generate, metrics, mobility, partition, profiles, reports, routing
from wayfare.sources import readers, sinks, stored, writers
from wayfare.streaming import sessions

# prev, now, (start, end) of two nodes as t, x, y, z; least distance, snapped time, midpoint
CASES = [
    (0, 20, (2, 0, 0, 0), (12, 10, 10, 10), (5, 10, 0, 10), (15, 0, 10, 10), 4.3359, 0, (6.5, 5.7, 8.6)),
    (6, 12, (2, 0, 0, 0), (6, 5, 5, 5), (6, 30, 30, 30), (10, 35, 35, 35), 43.3013, 6, (17.5, 17.5, 17.5)),
    (11, 14, (10, 52, 27, 27), (13, 62, 37, 37), (10, 27, 27, 27), (13, 28, 28, 28), 28.3196, 11, (41.3333, 28.8333, 28.8333)),
    (11, 12, (10, 62, 37, 37), (13, 50, 27, 27), (10, 24, 24, 24), (13, 27, 27, 27), 28.6628, 12, (40, 28.1667, 28.1667)),
    (10, 12, (11, 0, 0, 0), (13, -5, -5, -5), (11, 0, 0, 0), (13, -5, -5, -5), 0, 10, (2.5, 2.5, 2.5)),
    (12, 14, (11, 0, 0, 0), (13, -5, -5, -5), (11, -5, -5, -5), (13, -10, -10, -10), 8.6603, 12, (5, 5, 5)),
    (11, 14, (11, 0, 0, 0), (13, 0, 0, 0), (11, 0, 25, 0), (13, 0, 0, 0), 0, 14, (0, 0, 0)),
    (0, 10, (0, 0, 0, 0), (5, 25, 25, 25), (6, 0, 10, 10), (10, 25, 0, 0), 33.1042, 0, (2.0548, 17.1233, 17.1233)),
    (0, 10, (0, -1, -1, -1), (10, -25, -25, -25), (6, 0, -10, -10), (10, -25, -25, -24), 1.0, 10, (25, 25, 24.5)),
    (0, 8, (0, -1, -1, -1), (6, -25, -25, -25), (6, 0, -10, -10), (10, -25, -25, -24), 30.2738, 8, (22.75, 25.25, 25)),
]
POINT = "struct<t:double,x:double,y:double,z:double>"


def test_closest_approach_cases(spark):
    f = lambda p: tuple(map(float, p))
    rows = [(i, node, float(c[0]), float(c[1]), f(c[2 + 2 * node]), f(c[3 + 2 * node])) for i, c in enumerate(CASES) for node in (0, 1)]
    seg = spark.createDataFrame(rows, f"epoch long, node long, prev double, now double, start {POINT}, end {POINT}")
    got = {r.epoch: r for r in contacts.contacts(seg, 100.0).collect()}
    for i, c in enumerate(CASES):
        assert got[i].distance == pytest.approx(c[6], abs=1e-3) and got[i].time == c[7]
        assert (got[i].x, got[i].y, got[i].z) == pytest.approx(c[8], abs=1e-3)
    assert {r.epoch for r in contacts.contacts(seg, 25.0).collect()} == {0, 4, 5, 6, 8}


def walk(spark, n=12, seed=1, steps=60):
    import random

    r = random.Random(seed)
    rows = []
    for node in range(n):
        t, x, y = r.uniform(0, 50), r.uniform(0, 60), r.uniform(0, 60)
        for _ in range(steps):
            rows.append((node, t, x, y, 0.0))
            t, x, y = t + r.choice([0.5, 3, 10, 40]) * r.random() + 1e-3, x + r.gauss(0, 4), y + r.gauss(0, 4)
    return rows, spark.createDataFrame(rows, "node long, t double, x double, y double, z double")


def test_segments_against_plain(spark):
    rows, df = walk(spark)
    rows += [(50, float(t), 1.0, 1.0, 0.0) for t in (10, 20, 30, 60)]
    df = spark.createDataFrame(rows, df.schema)
    got = {(r.node, r.epoch): (r.start.t, r.end.t) for r in epochs.segments(df, 10.0, 60).collect()}
    want = {}
    for node in {r[0] for r in rows}:
        ts = sorted(r[1] for r in rows if r[0] == node)
        for i in range(60):
            prev, now = i * 10.0, (i + 1) * 10.0
            if ts[0] < prev and ts[-1] > now:
                want[node, i] = (max(t for t in ts if t <= prev), min(t for t in ts if t >= now))
    assert got == want


@pytest.mark.parametrize("cell,most", [(5.0, 64), (20.0, 4), (3.0, 1)])
def test_grid_join_equals_plain(spark, cell, most):
    _, df = walk(spark)
    seg = epochs.segments(df, 10.0, 60).cache()
    cols = ["epoch", "node1", "node2", "time", "distance", "x", "y"]
    rows = lambda d: sorted(tuple(round(v, 6) for v in r) for r in d.select(*cols).collect())
    plain = rows(contacts.contacts_of_all_pairs(seg, 6.0))
    assert plain and rows(contacts.contacts(seg, 6.0, cell=cell, most_cells=most)) == plain


@pytest.mark.parametrize(("crowd", "copies"), [(768, 2.5), (6, 20.0), (2, 100.0), (3, 1.0)])
def test_adaptive_join_equals_all_pairs(spark, monkeypatch, crowd, copies):
    for name, value in (("MOST_COPIES", copies), ("CROWD", crowd), ("LOT", crowd), ("ROW", 0), ("KEPT", 0.9)):
        monkeypatch.setattr(partition, name, value)
    rows, df = walk(spark, 40)
    rows += [(100 + i, t, 20.0, 20.0 + i / 100, 0.0) for i in range(12) for t in (5.0, 300.0)]  # a crowd in one place
    rows += [(200, t, None, 1.0, 0.0) for t in (5.0, 300.0)]
    seg = epochs.segments(spark.createDataFrame(rows, df.schema), 10.0, 60).cache()
    cols = ["epoch", "node1", "node2", "time", "distance", "x", "y"]
    found = lambda d: sorted(tuple(round(v, 6) for v in r) for r in d.select(*cols).collect())
    got = contacts.contacts(seg, 6.0)
    plain = found(contacts.contacts_of_all_pairs(seg, 6.0))
    assert plain and found(got) == plain
    plan = got._jdf.queryExecution().toString()
    alone = re.search(r"hashpartitioning\(epoch#\d+L?, \d+\)", plan)  # only where all of an epoch is one leaf
    assert bool(alone) == (crowd == 768) and ("leaf" in plan) == (crowd < 768)
    assert contacts.contacts(seg.limit(0), 6.0).count() == 0


def test_partition_of_a_hot_place(monkeypatch):
    import numpy as np

    monkeypatch.setattr(partition, "CROWD", 100)
    monkeypatch.setattr(partition, "LOT", 100)
    r = np.random.default_rng(1)
    centre = np.concatenate([r.normal(0, 20, (4000, 2)), r.uniform(-500, 500, (4000, 2)), np.tile([[100.0, 100.0]], (2000, 1))])
    boxes = np.column_stack([centre[:, 0] - 0.2, centre[:, 0] + 0.2, centre[:, 1] - 0.2, centre[:, 1] + 0.2])
    tree = partition.grow(boxes, r.integers(0, 4, len(boxes)), 1.0)
    leaves = [i for i, f in enumerate(tree.first) if f < 0]
    held = {}
    for i in leaves:
        x0, x1, y0, y1 = (s[i] for s in tree.sides)
        held[i] = ((boxes[:, 1] >= x0) & (boxes[:, 0] < x1) & (boxes[:, 3] >= y0) & (boxes[:, 2] < y1)).sum() / 4
    assert sum(held.values()) * 4 <= partition.MOST_COPIES * len(boxes)
    # What could not be cut, the 500 boxes an epoch in one place, is dealt to tiles of about a leaf's size.
    assert all(n / tree.tiles[i] <= 160 for i, n in held.items())
    assert sum(t > 1 for t in tree.tiles) >= 1 and len(leaves) > 30


def test_cooldown_against_a_plain_fold(spark):
    import random

    r, rows = random.Random(4), []
    for pair in range(60):
        for e in sorted(r.sample(range(400), r.choice((1, 2, 40)))):
            t = 10 * e + 10 * r.random()
            rows.append((pair, 1000, e, t, 10.0 * (e + round(t / 10 - e))))
    c = spark.createDataFrame(rows, "node1 long, node2 long, epoch long, t double, time double").cache()
    for gap in (0.0, 3.0, 25.0, 700.0, 1e9):
        want, last = set(), {}
        for p, _, e, t, time in rows:
            if p not in last or t - last[p] >= gap:
                want.add((p, e))
                last[p] = time
        assert {(x.node1, x.epoch) for x in contacts.cooldown(c, gap).collect()} == want


def test_cooldown_of_a_pair_with_100_000_contacts(spark):
    c = spark.range(100_000).select(F.lit(1).alias("node1"), F.lit(2).alias("node2"), F.col("id").alias("epoch"), (F.col("id") * 10 + 4.0).alias("t"), (F.col("id") * 10.0).alias("time"))
    assert sorted(r.epoch for r in contacts.cooldown(c, 35.0).select("epoch").collect()) == list(range(0, 100_000, 4))


def test_merge_split_and_cooldown(spark):
    c = spark.createDataFrame([(1, 2, e, float(10 * e + o), float(10 * e), 1.0, 1.0, 0.0) for e, o in [(0, 3), (1, 4), (2, 5), (5, 1), (7, 2)]], "node1 long, node2 long, epoch long, t double, time double, x double, y double, z double")
    m = encounters.merge(c, 10.0)
    assert sorted((r.time, r.duration) for r in m.collect()) == [(0, 20), (50, 10), (70, 10)]
    assert sorted((r.time, r.duration) for r in encounters.split(m, 10.0).collect()) == [(0, 10), (10, 10), (50, 10), (70, 10)]
    assert sorted((r.time, r.duration) for r in encounters.split(m, 15.0).collect()) == [(0, 15), (50, 10), (70, 10)]
    assert [r.epoch for r in contacts.cooldown(c, 20.0).orderBy("epoch").collect()] == [0, 2, 5, 7]
    assert [(r.node, r["count"], r.first_encounter) for r in encounters.encountered_nodes(m).orderBy("node").collect()] == [(1, 3, 0), (2, 3, 0)]


def test_clock_and_epochs(spark):
    assert [round(r.t, 6) for r in epochs.clock(spark, 2.6, 10.8, 2).orderBy("i").collect()] == [2.6, 4.6, 6.6, 8.6, 10.6]
    assert epochs.epochs(spark, 2.6, 10.8, 2).count() == 4 and epochs.epochs(spark, 2.6, 10.8, 2, drop_tail=True).count() == 2


def test_conditions():
    found, text = contacts.read_conditions({"conditions": []})
    assert (found, text) == ([], "")
    with pytest.raises(ValueError):
        contacts.read_conditions({})


def test_geodesy(spark):
    lat, lon = F.col("lat"), F.col("lon")
    rows = spark.createDataFrame([(38.907971, -77.071614), (38.900680, -77.048783)], "lat double, lon double").select(*geo.ecef(lat, lon, F.lit(0.0)), *geo.mercator(lat, lon)).collect()
    assert math.dist(rows[0][:3], rows[1][:3]) == pytest.approx(2135.5, abs=10)
    one = spark.range(1).select(geo.cell_distance([F.lit(float(v)) for v in (100, 200, 300)], [F.lit(float(v)) for v in (1, 2, 3)], 20.0).alias("d"), rng.uniform(3, "id").alias("u")).first()
    assert one.d == pytest.approx(7408.481625812404) and one.u == rng.uniform_py(3, 0)


def test_scalars(spark):
    r = spark.createDataFrame([("foobar", "aab", "m_k=4_p=0.6")], "a string, b string, n string").select(scalars.fnv1a64(F.col("a")).alias("h"), scalars.entropy(F.col("b")).alias("e"), scalars.name_parameter(F.col("n"), "p").alias("p"), scalars.decrypted(scalars.encrypted(F.col("a"), F.lit("0123456789abcdef")), F.lit("0123456789abcdef")).alias("back"), scalars.complete_shards(F.array(F.lit(0), F.lit(2))).alias("c")).first()
    assert r.h == str(0x85944171F73967E8) and r.e == pytest.approx(0.9182958) and r.p == "0.6" and r.back == "foobar" and r.c is False


E = routing.Encounter
T0 = 1200000000.0


def message(i, sender, to, **kw):
    return routing.Message(f"m{i:02d}", sender, to, T0, **({"ttl_hops": 20, "ttl_time": 1e6} | kw))


def bandwidths(messages, met, policy, capacity=None):
    return [(r[11], r[12]) for r in routing.fold("x", messages, met, policy, capacity) if r[1] == "load"]


def test_exchange_scenarios():
    one, two, far = E(T0, 1, 2, 10), E(T0 + 20, 1, 2, 10), E(T0 + 30, 2, 3, 10)
    assert bandwidths([message(i, 1, 2) for i in range(10)], [one], routing.Broadcast()) == [(10, 0)]
    assert bandwidths([message(i, 1, 2) for i in range(5)] + [message(10 + i, 2, 1) for i in range(20)], [one], routing.Broadcast()) == [(25, 0)]
    assert bandwidths([message(0, 1, 3)], [one, far], routing.Broadcast()) == [(1, 0), (1, 0)]
    assert bandwidths([message(i, 1, 2) for i in range(25)], [one], routing.Broadcast(), 5.0) == [(5, 0)]
    rows = list(routing.fold("x", [message(i, 1, 2) for i in range(25)], [one], routing.Broadcast(), 5.0))
    assert sum(r[1] == "drop" for r in rows) == 20
    assert bandwidths([message(0, 1, 9)], [one, two], routing.RandomWalk(1.0, 1.0, second_first=False)) == [(2, 0)]  # one bounce back, then never straight back
    assert bandwidths([message(0, 1, 2, ttl_time=5)], [two], routing.Broadcast()) == []
    line = [E(T0 + i, i, i + 1, 1) for i in range(1, 6)]
    assert [r[7] for r in routing.fold("x", [message(0, 1, 9, ttl_hops=1)], line, routing.Broadcast()) if r[1] == "transfer"] == [1, 2]
    delivered = [r for r in routing.fold("x", [message(0, 1, 3)], [one, far, E(T0 + 40, 1, 3, 1)], routing.Broadcast()) if r[1] == "delivery"]
    assert len(delivered) == 1 and delivered[0][7] == 2


@pytest.mark.parametrize("p", [0.2, 0.4, 0.6, 0.8, 1.0])
def test_walk_probability(p):
    met = [E(T0 + k, 2 * k, 2 * k + 1, 10) for k in range(20)]
    messages = [routing.Message(f"m{k}-{i}", 2 * k, 999, T0) for k in range(20) for i in range(50)]
    moved = sum(b for b, _ in bandwidths(messages, met, routing.RandomWalk(p, 0.0)))
    assert abs(moved / 1000 - p) <= 0.05


@pytest.mark.parametrize("age,constant,low,high", [(500, 1000, 0.42, 0.58), (1000, 1000, 1, 1), (0, 1000, 0, 0.02)])
def test_aged_walk(age, constant, low, high):
    messages = [routing.Message(f"m{i}", 1, 9, T0) for i in range(400)]
    moved = sum(b for b, _ in bandwidths(messages, [E(T0 + age, 1, 2, 10)], routing.AgedWalk(delete=0.0, constant=constant)))
    assert low <= moved / 400 <= high


def test_flooding_dominates_and_equals_the_fold(spark):
    _, df = walk(spark)
    met = encounters.merge(contacts.contacts(epochs.segments(df, 10.0, 60), 5.0), 10.0).cache()
    born = encounters.births(met)
    messages = generate.with_template(generate.direct_messages(born, 3), {"ttl_hops": 1000, "ttl_time": 10**9}, 1).cache()
    runs = {n: routing.replay(messages, met, p, n).where("kind in ('transfer', 'delivery')").collect() for n, p in (("flood", routing.Broadcast()), ("walk", routing.RandomWalk(0.7, 1.0)), ("mixed", routing.Mixed()))}
    got = {n: {r.message_id for r in rows if r.kind == "delivery"} for n, rows in runs.items()}
    assert got["walk"] <= got["flood"] and got["mixed"] <= got["flood"] and got["flood"]
    one = {(r.message_id, r.reciever_node): r.time for r in runs["flood"] if r.kind == "transfer"}
    joined = {(r.message_id, r.node): r.time for r in routing.flood(messages.select("id", "sender", "time"), met).where("hops > 0").collect()}
    assert joined == one
    bounded = routing.replay(messages, met, routing.Broadcast(), "b", capacity=3.0).where("kind = 'delivery'").count()
    assert bounded <= len(got["flood"])


def test_generators(spark):
    born = spark.createDataFrame([(i, float(i)) for i in range(30)], "node long, birth double")
    assert generate.group_messages(born).count() == 30 * 29
    bulk = generate.bulk_messages(born, 1).collect()
    assert len(bulk) == 300 and len({(r.sender, r.destinationnode) for r in bulk}) == 300 and all(r.sender != r.destinationnode for r in bulk)
    direct = generate.direct_messages(born, 1).collect()
    assert len({r.destinationnode for r in direct}) == 30 and all(r.sender != r.destinationnode for r in direct)
    assert generate.direct_messages(born.where("node = 1"), 1).count() == 0 and generate.bulk_messages(born.where("node < 3"), 1).count() == 6


def test_shards_graphs_and_loads(spark):
    s = spark.createDataFrame([("a_0", 0, True, "x", 1.0), ("a_1", 1, False, "y", 2.0), ("b_0", 0, True, "x", 1.0), ("c_1", 1, False, "x", 1.0)], "message_id string, shardid int, ms boolean, payload string, time double")
    assert [(r.message_id, r.payload, r.time) for r in routing.reassembled(s).collect()] == [("a", "xy", 2.0)]
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1)], "node long, d1 int, d2 int")
    assert {(r.d1, r.d2): r.weight for r in mobility.graph_weights(e).collect()} == {(0, 1): 1.0, (1, 2): 0.5}
    same = mobility.randomised(e, e.select("node").distinct(), 3, 1.0, 1)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, e.collect()))
    with pytest.raises(ValueError):
        mobility.attacked(e, "none")
    d = spark.createDataFrame([("e", 1.0, "m", 1), ("e", 2.0, "m", 1), ("e", 3.0, "m", -1)], "experiment_name string, time double, message_id string, delta int")
    assert [(r.now, r.load) for r in metrics.epoch_loads(d).orderBy("now").collect()] == [(1, 0), (2, 1), (3, 2)]
    flat = spark.createDataFrame([("e", 5.0)] * 3, "g string, v double")
    assert sum(r["count"] for r in reports.histogram10(flat, F.col("v"), ["g"]).collect()) == 3
    with pytest.raises(ValueError):
        reports.at_least_two(spark.range(1))
    ev = spark.createDataFrame([(1, float(i), 0.0, 0.0, 0.0) for i in range(25)] + [(2, 0.0, 1.0, 1.0, 1.0)], "node long, t double, x double, y double, z double")
    assert profiles.head_split(ev).where("in_profile").count() == 2


def test_named_traces_are_parsed_once(spark, tmp_path):
    for name, time in (("new_b", 5), ("new_a", 6)):
        (tmp_path / f"{name}.txt").write_text(f"10.0 20.0 0 {time}\n10.5 20.0 0 {time}\n95.0 20.0 0 7\nx 20.0 0 8\n")
    flat = readers.import_traces(spark, "cabspotting2d", str(tmp_path), "c")
    assert all(f.endswith(".parquet") for f in flat.inputFiles())  # the text files were read anew for keys, their ranges and rows before
    assert sorted((r.node, r.time) for r in flat.collect()) == [(0, 6.0), (1, 5.0)]  # no place beyond the poles on a map
    globe = readers.import_traces(spark, "cabspotting", str(tmp_path), "c")
    assert sorted((r.node, r.time) for r in globe.collect()) == [(0, 6.0), (0, 7.0), (1, 5.0), (1, 7.0)]


def test_readers(spark, tmp_path):
    d = tmp_path / "t"
    (d / "sub").mkdir(parents=True)
    (d / "b.txt").write_text("7,2008-02-02 15:36:08,116.5,39.9\n7,2008-02-02 15:36:08,1.0,2.0\n7,bad,1,2\n")
    (d / "sub" / "c.txt").write_text("9,2008-02-02 15:36:09,116.5,39.9\n")
    rows = sorted(readers.import_traces(spark, "tdrive", str(d), "x").collect(), key=lambda r: r.node)
    assert [(r.node, r.time) for r in rows] == [(0, 1201966568.0), (1, 1201966569.0)] and rows[0].x == pytest.approx(rows[1].x)
    j = tmp_path / "j"
    j.mkdir()
    (j / "a.csv").write_text("uid,d,t,x,y\n3,1,2,10,20\n3,1,2,11,20\n")
    assert [tuple(r) for r in readers.import_traces(spark, "japan", str(j), "y").collect()] == [("y", 1704067200.0 + 86400 + 3600, 3, 5000.0, 10000.0, 0.0)]
    g = tmp_path / "Data" / "007"
    g.mkdir(parents=True)
    (g / "x.plt").write_text("h\n" * 6 + "39.9,116.3,0,-777,1,2009-10-11,14:04:30\n")
    one = readers.import_traces(spark, "geolife", str(tmp_path / "Data"), "g").collect()
    assert len(one) == 1 and one[0].time == 1255269870.0 and math.sqrt(one[0].x ** 2 + one[0].y ** 2 + one[0].z ** 2) < 6378137
    m = tmp_path / "m"
    m.mkdir()
    (m / "a.csv").write_text("n1   1000  39.9 116.3  5\nbroken\n")
    assert readers.import_traces(spark, "mdc", str(m), "m").count() == 1
    c = tmp_path / "c"
    c.mkdir()
    (c / "new_ab.txt").write_text("37.7 -122.4 0 1213084687\n")
    assert [r.z for r in readers.import_traces(spark, "cabspotting2d", str(c), "c").collect()] == [0.0]
    s = tmp_path / "s"
    s.mkdir()
    (s / "a.json").write_text(json.dumps([{"user": 1, "simtime": 5, "position": {"X": 1, "Y": 2, "Z": 3}}]))
    assert [tuple(r)[1:] for r in readers.import_traces(spark, "simple", str(s), "s").collect()] == [(5.0, 1, 1.0, 2.0, 3.0)]
    with pytest.raises(ValueError):
        readers.import_traces(spark, "none", str(s), "s")
    (tmp_path / "msg.json").write_text(json.dumps({"4": [{"id": "a", "destinationnode": 5, "time": 1.0, "ttl_secs": 7}]}))
    r = readers.read_messages(spark, str(tmp_path / "msg.json")).first()
    assert (r.sender, r.destinationnode, r.destination, r.ttl_time) == (4, 5, "5", 7)
    assert readers.read_template('{"a": 1}') == readers.read_template('[{"a": 1}]')


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", 1.005, True), ("b", 2.0, False)], "experiment_name string, v double, f boolean")
    sinks.store(df, root, "results", "experiment_name")
    sinks.store(df.where("experiment_name = 'a'").withColumn("v", F.lit(9.0)), root, "results", "experiment_name")
    assert {r.experiment_name: r.v for r in spark.read.parquet(f"{root}/results").collect()} == {"a": 9.0, "b": 2.0}
    sinks.delete(spark, root, "results", "experiment_name", "b")
    assert spark.read.parquet(f"{root}/results").count() == 1
    assert [tuple(r) for r in sinks.as_text(df).collect()] == [("a", "1.00", "true"), ("b", "2.00", "false")] or [r.v for r in sinks.as_text(df).collect()] == ["1.01", "2.00"]
    sinks.export_csv(df, f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").columns == df.columns
    assert sinks.clear(spark, root, ["results", "events"]) == ["results"]
    n = []
    for _ in range(2):
        encounters.cached(spark, root, {"step": 1}, lambda: n.append(1) or df)
    assert n == [1]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(float(t), 1, 2) for t in (0, 5, 8, 100, 104, 300)]
    spark.createDataFrame(rows, "t double, node1 long, node2 long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("t double, node1 long, node2 long").parquet(str(src))
    timed = stream.withColumn("ts", F.timestamp_seconds("t"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    found = run(sessions.contact_sessions(timed, "10 seconds", "20 seconds"), "sess")
    assert sorted(r.contacts for r in found) == [2, 3]
    assert len(run(sessions.epoch_counts(timed.withColumnRenamed("node1", "node"), "60 seconds", "20 seconds"), "ep")) == 2
    assert sorted(r.t for r in run(sessions.cooldown(stream, 7.0), "cool")) == [0, 8, 100, 300]


def test_flooding_by_next_meetings_against_plain_rounds(spark):
    """A hub that meets few nodes again and again, ties in time, repeated rows, a null, senders that never meet."""
    import random

    r = random.Random(5)
    met = [(float(r.randrange(40)), 0, r.randrange(1, 6)) for _ in range(400)] + [(float(r.randrange(40)), *sorted(r.sample(range(1, 15), 2))) for _ in range(60)]
    met += met[:30]
    df = spark.createDataFrame([*met, (None, 1, 2)], "time double, node1 long, node2 long").repartition(7)
    sent = [(f"m{i}", r.randrange(16), r.choice([-1.0, r.uniform(0, 45)])) for i in range(40)] + [("alone", 99, 3.0)]
    messages = spark.createDataFrame(sent, "id string, sender long, time double")
    for hops, small in ((2, 1 << 20), (None, 0)):
        want = {}
        for m, sender, born in sent:
            reached = {sender: ((born, -1, -1), 0)}
            fresh, hop = dict(reached), 0
            while fresh and (hops is None or hop < hops):
                hop += 1
                found = {}
                for e in met:
                    for a, b in ((e[1], e[2]), (e[2], e[1])):
                        if a in fresh and e > fresh[a][0] and e < found.get(b, ((1e9,), 0))[0]:
                            found[b] = (e, hop)
                fresh = {k: v for k, v in found.items() if k not in reached or v[0] < reached[k][0]}
                reached |= fresh
            want |= {(m, k): (*e, h) for k, (e, h) in reached.items()}
        got = routing.flood(messages, df, hops, sinks.checkpointed, small).collect()
        assert {(x.message_id, x.node): (x.time, x.node1, x.node2, x.hops) for x in got} == want and len(got) == len(want)
    assert routing.flood(messages, df.limit(0), None, sinks.checkpointed).count() == len(sent)
    assert routing.flood(messages.limit(0), df, None, sinks.checkpointed).count() == 0


def test_swept_flood_against_a_plain_fold(spark, monkeypatch):
    """Rounds, runs in pieces, lots that end early, an id of type long; no index of pairs is made."""
    import random

    r = random.Random(9)
    met = [(float(r.randrange(30)), *sorted(r.sample(range(40), 2))) for _ in range(900)] + [(4.0, 7, n) for n in range(8, 40)]
    df = spark.createDataFrame(met, "time double, node1 long, node2 long").repartition(2)
    rows = [(i, r.randrange(45), r.choice([-1.0, r.uniform(0, 32)])) for i in range(30)]
    sent = spark.createDataFrame(rows, "id long, sender long, time double").repartition(2)
    for name, value in (("PIECE", 3), ("PRUNE", 5), ("next_meetings", None)):
        monkeypatch.setattr(routing, name, value)
    once = sent.select(F.col("id").alias("message_id"), F.col("sender").alias("node"), "time")
    for hops, most in ((None, 400), (2, 1 << 20)):
        want = {}
        for i, sender, born in rows:
            least = {sender: 0}
            for e in sorted(set(met)):
                a, b = least.get(e[1], 1e9), least.get(e[2], 1e9)
                for node, mine, theirs in ((e[1], a, b), (e[2], b, a)):
                    if e[0] >= born and theirs < (hops or 1e8):
                        if node not in least:
                            want[i, node] = (*e, theirs + 1)
                        least[node] = min(mine, theirs + 1)
        got = routing.swept(once, df.distinct(), hops, sinks.checkpointed, most).collect()
        assert {(x.message_id, x.node): (x.time, x.node1, x.node2, x.hops) for x in got} == want and len(got) == len(want)


def test_next_meetings_are_few_rows(spark):
    ranked = spark.range(20_000).selectExpr("id rank", "0L node1", "1 + id % 7 node2")
    index = routing.next_meetings(ranked, 20_000)
    assert index.count() <= 2 * 40_000 + 14
    asked = index.where("holder = 0 and since <= 12345 and 12345 < met")
    assert {(x.node, x.met) for x in asked.collect()} == {(1 + m % 7, m) for m in range(12346, 12353)}
    assert max(x["count"] for x in index.where("holder = 0").groupBy("block").count().collect()) <= 3 * 7


def test_unbounded_broadcast_floods_from_every_node(spark, tmp_path, monkeypatch):
    import random

    from wayfare.plans import profiles as plans

    r = random.Random(8)
    met = [(float(t), *sorted(r.sample(range(1, 25), 2))) for t in range(60)]
    df = spark.createDataFrame(met, "time double, node1 long, node2 long")
    monkeypatch.setattr(plans.a, "encounter", lambda *_, **__: df)
    want = {}
    for sender in {n for _, *pair in met for n in pair}:
        born = next(t for t, x, y in met if sender in (x, y))
        arrived = {sender: born}
        for t, x, y in met:
            for holder, node in ((x, y), (y, x)):
                if t >= born and holder in arrived and (arrived[holder] < t or holder == sender) and node not in arrived:
                    arrived[node] = t
        want |= {(str(sender), n): t for n, t in arrived.items()}
    assert {(x.message_id, x.node): x.time for x in plans.broadcast_unbounded(spark, str(tmp_path)).collect()} == want


def test_acceptance_is_the_same_under_any_partitioning(spark):
    import random

    r = random.Random(6)
    rows = [(n, r.randrange(12), r.randrange(12), 0, r.randrange(1, 50), 1.0) for n in range(60) for _ in range(30)]
    visits = spark.createDataFrame(list({x[:4]: x for x in rows}.values()), "node long, cx long, cy long, cz long, visits long, reached double").cache()
    home = profiles.popular_cell(visits).select(F.col("node").alias("destination"), *profiles.CELL)
    messages = spark.createDataFrame([(i, i % 61, i % 70) for i in range(2000)], "id long, node long, destination long")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in (4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = profiles.accepted(profiles.addressed(messages.repartition(n), home), visits.repartition(n), 7.0).select("id", "cx", "accepted").collect()
            seen.add(tuple(sorted((x.id, x.accepted) for x in got)))
            assert all(not x.accepted for x in got if x.cx is None) and sum(x.cx is None for x in got) == sum(i % 70 > 59 for i in range(2000))
            limits = tuple(sorted((x.node, x.threshold) for x in profiles.thresholds(visits.repartition(n), 7.0).collect()))
            seen.add(limits)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 2
    # A node takes what is addressed to any of its own cells.
    own = profiles.accepted(visits.select("node", *profiles.CELL), visits, 7.0)
    assert own.where("not accepted").count() == 0


def test_merge_by_key(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = lambda: sorted((r.k, r.v) for r in stored.read(spark, root, "t").collect())
    base = spark.range(0, 1000).select(F.col("id").alias("k"), F.lit(0.0).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert stored.merge(base, root, "t", ["k"]) == 1
        first = set(stored._latest(spark, f"{root}/t")[1])
        assert len(first) > 2
        up = spark.createDataFrame([(3, 1.0, 1), (3, 2.0, 5), (3, 9.0, 2), (2000, 4.0, 1)], "k long, v double, seq int")
        assert stored.merge(up.select("k", "v"), root, "t", ["k"]) == 2 and (3, 9.0) in rows()
        assert stored.merge(up.drop("seq").limit(0), root, "t", ["k"]) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows()) == 1001 and (2000, 4.0) in rows()
    assert len(first & set(stored._latest(spark, f"{root}/t")[1])) == len(first) - 1  # one file was touched
    # A writer that dies before it publishes leaves the version before, and the next one goes on from there.
    old = rows()
    create = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stored.merge(base.withColumn("v", F.lit(7.0)), root, "t", ["k"])
    monkeypatch.undo()
    assert create and rows() == old
    (tmp_path / "t" / "manifest" / "000000003").mkdir()  # begun, not published
    assert stored._latest(spark, f"{root}/t")[0] == 2
    sinks.remove(spark, f"{root}/t/manifest/000000003")
    assert stored.merge(spark.createDataFrame([(None, 5.0), (None, 5.0)], "k long, v double"), root, "t", ["k"]) == 3 and stored.read(spark, root, "t").count() == 1003
    with pytest.raises(ValueError):
        stored.read(spark, root, "none")


def test_delete_dataset_takes_all_that_hangs_on_it(spark, tmp_path):
    root = str(tmp_path)
    both = lambda df, name, by: sinks.store(df, root, name, by)
    both(spark.createDataFrame([("a b/1", 1), ("c", 2)], "dataset_name string, node long"), "events", "dataset_name")
    both(spark.createDataFrame([("a b/1", "x"), ("c", "z")], "dataset_name string, experiment_name string"), "experiments", "experiment_name")
    both(spark.createDataFrame([("a b/1", "y")], "family_dataset string, experiment_name string"), "experiment_families", "experiment_name")
    both(spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "experiment_name string, n int"), "results_dbs", "experiment_name")
    assert len(stored.delete_dataset(spark, root, "a b/1")) == 5
    assert [r.experiment_name for r in spark.read.parquet(f"{root}/results_dbs").collect()] == ["z"]
    assert [r.dataset_name for r in spark.read.parquet(f"{root}/events").collect()] == ["c"]
    assert stored.delete_dataset(spark, root, "a b/1") == []


def test_half_made_encounters_are_made_anew(spark, tmp_path):
    df = spark.range(3)
    encounters.cached(spark, str(tmp_path), {"a": 1}, lambda: df)
    folder = next(tmp_path.glob("encounters-*"))
    (folder / "_SUCCESS").unlink()
    assert encounters.cached(spark, str(tmp_path), {"a": 1}, lambda: spark.range(5)).count() == 5


def test_writers_refuse_and_repeat(spark, tmp_path):
    rows = spark.createDataFrame([(7, 100.0, 0, "10.5", "20.25", "3"), (7, 100.0, 1, "11", "20", "3"), (12, 50.0, 0, "-1", "2", "0")], "node long, time double, nth long, lat string, lon string, alt string")
    with pytest.raises(ValueError):
        writers.write_traces(rows, "geolife", str(tmp_path / "g"))
    writers.write_traces(rows, "tdrive", str(tmp_path / "t"))
    got = sorted((r.node, r.time) for r in readers.import_traces(spark, "tdrive", str(tmp_path / "t"), "x").collect())
    assert got == [(0, 50.0), (1, 100.0)]  # files in order of their paths; the first of a node's rows of one time
    assert readers.import_traces(spark, "tdrive", str(tmp_path / "t"), "x").where("node = 1").first().x == pytest.approx(readers.import_traces(spark, "tdrive", str(tmp_path / "t"), "x").where("time = 100").first().x)


def test_ordered_cooldown_over_batches_equals_the_batch_form(spark, tmp_path):
    import random

    r, src = random.Random(9), tmp_path / "in"
    rows = sorted((round(r.uniform(0, 2000), 3), a, 100) for a in range(8) for _ in range(60))
    # Out of order by up to 30 s; eight batches, and one far ahead that lets all others end.
    arrived = sorted(rows, key=lambda x: x[0] + r.uniform(0, 30))
    for i in range(9):
        part = arrived[60 * i : 60 * i + 60] if i < 8 else [(9000.0, 999, 1000)]
        spark.createDataFrame(part, "t double, node1 long, node2 long").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.02)  # files are taken in order of their age
    stream = spark.readStream.schema("t double, node1 long, node2 long").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = sessions.ordered_cooldown(stream.withColumn("ts", F.timestamp_seconds("t")), 90.0, "40 seconds")
    q = out.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((x.node1, x.t) for x in spark.table("ordered").collect())
    want, last = [], {}
    for t, a, _ in rows:
        if a not in last or t - last[a] >= 90.0:
            last[a] = t
            want.append((a, t))
    assert got == sorted(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the pair far ahead, which still waits


def test_originations_against_plain(spark):
    import random

    r = random.Random(8)
    met = [(s, r.randrange(6), 6 + r.randrange(6), float(r.randrange(50)), float(r.randrange(1, 9))) for s in range(200)]
    messages = [(f"m{i}", r.randrange(12), float(r.randrange(70))) for i in range(60)]
    got = generate.originations(spark.createDataFrame(messages, "id string, sender long, time double"), spark.createDataFrame(met, "seq long, node1 long, node2 long, time double, duration double"))
    want = {(i, min(s for s, a, b, at, d in met if n in (a, b) and at + d >= t)) for i, n, t in messages if any(n in (a, b) and at + d >= t for _, a, b, at, d in met)}
    assert {(x.id, x.seq) for x in got.collect()} == want


def test_fnv_against_plain(spark):
    def plain(text):
        h = 14695981039346656037
        for b in text.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return str(h)

    texts = ["", "a", "foobar", "é\U0001f600 \x00", "x" * 3000, "12.500000712"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", scalars.fnv1a64(F.col("t")).alias("h")).collect()
    assert [(r.t, r.h) for r in got] == [*[(t, plain(t)) for t in texts], (None, None)]


def test_pairs_at_exactly_reach_are_contacts(spark):
    """Nodes on two lines 5 apart pass each other: their least distance is exactly 5, whatever the rounding of what is added up."""
    import random

    r = random.Random(11)
    rows = [(0, i, 0.0, 21600.0, (-r.uniform(1, 9e4), r.uniform(-400, 400), 5.0 * (i % 2), 0.0), (21600 + r.uniform(1, 9e4), r.uniform(-400, 400), 5.0 * (i % 2), 0.0)) for i in range(300)]
    seg = spark.createDataFrame(rows, f"epoch long, node long, prev double, now double, start {POINT}, end {POINT}")

    def place(row, t):
        (a, x, *_), (b, y, *_) = row[4], row[5]
        return x + (y - x) / (b - a) * (t - a)

    crossed = {(p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and (p[1] + q[1]) % 2 and (place(p, 0.0) - place(q, 0.0)) * (place(p, 21600.0) - place(q, 21600.0)) < 0}
    for found in (contacts.contacts(seg, 5.0), contacts.contacts(seg, 5.0, cell=24.0), contacts.contacts_of_all_pairs(seg, 5.0)):
        near = {(x.node1, x.node2): x.distance for x in found.collect()}
        assert len(crossed) > 3000 and crossed <= set(near) and max(near.values()) == 5.0


def test_first_contacts_equal_births_of_all_encounters(spark, monkeypatch):
    """The same times as from all contacts, by few comparisons where nodes meet many, by all for those that meet nobody."""
    import random

    r = random.Random(3)
    rows = [(i, float(t), r.uniform(0, 60) if i < 115 else 1000.0 * i, r.uniform(0, 60), 0.0) for i in range(120) for t in sorted(r.sample(range(3000), 25))]
    seg = epochs.segments(spark.createDataFrame(rows, "node long, t double, x double, y double, z double"), 100.0, 30).cache()
    want = {x.node: x.birth for x in encounters.births(encounters.merge(contacts.contacts(seg, 2.0), 100.0)).collect()}
    compared, near = [], contacts._near
    monkeypatch.setattr(contacts, "FIRST_LOT", 16)
    monkeypatch.setattr(contacts, "_near", lambda pairs, *rest: compared.append(pairs.count()) or near(pairs, *rest))
    for few in (contacts.FEW_ROWS, 0):
        monkeypatch.setattr(contacts, "FEW_ROWS", few or 1)
        compared.clear()
        got = contacts.first_contacts(seg, 2.0).collect()
        assert {x.node: x.birth for x in got} == want and len(got) == len(want) > 100
        assert sum(compared) < seg.count() * 120 / 2
    assert contacts.first_contacts(seg.limit(0), 2.0).count() == 0


def test_encounters_by_blocks_equal_merged_contacts(spark, monkeypatch):
    """Blocks of nodes meet through all epochs: the same encounters, to the last bit, and contacts are not shuffled."""
    monkeypatch.setattr(encounters, "BLOCK_NODES", 25)
    monkeypatch.setattr(encounters, "AT_ONCE", 3000)
    rows, df = walk(spark, 90)
    rows += [(500 + i, t, 20.0, 20.0 + i / 4, z) for i, z in enumerate((0.0, 1.0, 9.0)) for t in (5.0, 300.0)]  # that stay together
    rows += [(600, t, None, 1.0, 0.0) for t in (5.0, 300.0)] + [(None, t, 20.0, 20.0, 0.0) for t in (5.0, 300.0)] + [(601, 1.0, 20.0, 20.0, 0.0)]
    seg = epochs.segments(spark.createDataFrame(rows, "node long, t double, x double, y double, z double"), 10.0, 60).cache()
    for kind in ("long", "string"):
        typed = seg.withColumn("node", F.col("node").cast(kind))
        got = encounters.met(typed, 6.0, 10.0)
        want = encounters.merge(contacts.contacts_of_all_pairs(typed, 6.0), 10.0)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("duration > 100").count() == 1
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Window" not in plan and "SortMergeJoin" not in plan
    assert encounters.met(seg.limit(0), 6.0, 10.0).count() == 0
    for name, value in (("MOST_COPIES", 100.0), ("CROWD", 2), ("LOT", 2), ("ROW", 0), ("KEPT", 0.9)):
        monkeypatch.setattr(partition, name, value)
    monkeypatch.setattr(encounters, "WORTH", 1.0)
    cut = encounters.met(seg, 6.0, 10.0)  # where a partition saves pairs, by it
    assert "Window" in cut._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, cut.collect())) == sorted(map(tuple, encounters.merge(contacts.contacts_of_all_pairs(seg, 6.0), 10.0).collect()))


def test_contacts_by_blocks_equal_all_pairs(spark, monkeypatch):
    """Blocks of nodes give all contacts, to the last bit, and no box is copied to tiles."""
    monkeypatch.setattr(encounters, "BLOCK_NODES", 25)
    monkeypatch.setattr(encounters, "AT_ONCE", 3000)
    monkeypatch.setattr(encounters, "ROWS", 50)
    monkeypatch.setattr(partition, "LOT", 20)
    rows, df = walk(spark, 90)
    seg = epochs.segments(df, 10.0, 60).cache()
    for node, epoch in (("long", "long"), ("string", "int")):
        typed = seg.withColumns({"node": F.col("node").cast(node), "epoch": F.col("epoch").cast(epoch)})
        got, want = encounters.met_contacts(typed, 6.0), contacts.contacts_of_all_pairs(typed, 6.0)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
    assert encounters.met_contacts(seg.limit(0), 6.0).count() == 0


def test_originations_sort_few_encounters(spark):
    """The first encounter in order that lasts until the creation, while the ends of encounters are not sorted one by one."""
    import random

    r = random.Random(6)
    met = [(n, *sorted(r.sample(range(9), 2)), float(n // 100), float(r.choice((0, 1, 5)))) for n in range(3000)]
    sent = [(f"m{i}", i % 10, float(r.randrange(-3, 40))) for i in range(60)]
    messages, df = spark.createDataFrame(sent, "id string, sender long, time double"), spark.createDataFrame(met, "seq long, node1 long, node2 long, time double, duration double")
    out = generate.originations(messages, df)
    first = lambda m: next((e[0] for e in met if m[1] in e[1:3] and e[3] + e[4] >= m[2]), None)
    assert sorted((x.id, x.seq) for x in out.collect()) == sorted((m[0], first(m)) for m in sent if first(m) is not None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")


def test_popular_encounters_without_all_of_them(spark):
    """Contacts of a few nodes are those of all pairs that have one of them; popular nodes are counted by side in one pass."""
    _, df = walk(spark, 40)
    seg = epochs.segments(df, 10.0, 60).cache()
    every = contacts.contacts_of_all_pairs(seg, 8.0).cache()
    met = encounters.merge(every, 10.0).cache()
    top = reports.popular(met, 5)
    ends = [(n, side) for r in met.collect() for n, side in ((r.node1, "node1"), (r.node2, "node2"))]
    want = sorted((-ends.count(e), *e) for e in set(ends))[:5]
    assert sorted((-r.n, r.popular, r.side) for r in top.collect()) == want
    nodes = sorted({e[1] for e in want})
    got = contacts.contacts_of(seg, nodes, 8.0)
    few = every.where(F.col("node1").isin(nodes) | F.col("node2").isin(nodes))
    assert got.dtypes == few.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, few.collect())) and 0 < few.count() < every.count()
    mine = encounters.merge(got, 10.0)
    assert sorted(map(tuple, reports.popular_encounters(mine, top).collect())) == sorted(map(tuple, reports.popular_encounters(met, top).collect()))


def test_replay_streams_its_encounters(spark, monkeypatch):
    """A task of replay keeps few encounters at one time, and the rows are those of the plain fold, in any number of lots."""
    import random

    r = random.Random(4)
    met = [(float(t // 3), *sorted(r.sample(range(12), 2)), 1.0, 0.0, 0.0, 0.0) for t in range(900)]
    sent = [(f"m{i}", r.randrange(12), r.randrange(12), float(r.randrange(200)), 1.0, 20 if i % 3 else 1, 60.0 if i % 2 else 1e6) for i in range(24)]
    df = spark.createDataFrame(met, "time double, node1 long, node2 long, duration double, x double, y double, z double").repartition(5)
    messages = spark.createDataFrame(sent, "id string, sender long, destinationnode long, time double, size double, ttl_hops int, ttl_time double")
    policies = (routing.Broadcast(), routing.RandomWalk(0.6, 0.7), routing.ByCell({n: 0b101 << n % 2 for n in range(12)}, cell={n: n % 3 for n in range(11)}))
    accepted = {(n, to) for n in range(12) for to in range(11) if 0b101 << n % 2 >> to % 3 & 1}
    for copies in (routing.COPIES, 20):
        monkeypatch.setattr(routing, "COPIES", copies)
        for policy in policies:
            plain = routing.Profiled(accepted) if isinstance(policy, routing.ByCell) else policy
            want = [x for i in sent for x in routing.fold("x", [routing.Message(*i)], [routing.Encounter(*e) for e in met], plain) if x[1] != "load"]
            got = [tuple(x) for x in routing.replay(messages, df, policy, "x", lots=2).where("kind <> 'load'").collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr) and len({x[1] for x in got}) >= 3
    assert "applyInPandas" not in routing.replay.__code__.co_names and not hasattr(routing.Message("m", 1, 2, 0.0), "__dict__")


def test_lookout_skips_what_changes_nothing():
    """Arrays of encounters give the rows of the plain fold, and most encounters are not looked at."""
    import random

    r = random.Random(8)
    nodes = np.arange(0, 600, 3)
    met = [routing.Encounter(float(t // 40), *sorted(r.sample(nodes.tolist(), 2)), 1.0, *(r.choice((0.0, 4.0, 9.0)) for _ in "xyz")) for t in range(12_000)]
    met.sort(key=lambda e: (e.time, e.node1, e.node2))
    sent = [routing.Message(f"m{i}", r.choice(nodes), int(r.choice(nodes)), float(i % 90), 1.0, 20 if i % 3 else 2, 60.0 if i % 2 else 1e6) for i in range(70)]
    graphs = {int(n): {(0, 1)} if n % 2 else {(0, 1), (1, 2)} for n in nodes}
    policies = [
        (routing.RandomWalk(0.6, 1.0), 0.7), (routing.Broadcast(), 0.9), (routing.AgedWalk(delete=0.0, constant=500.0), 1), (routing.Mixed(ideal=0.2), 1),
        (routing.ByCell({int(n): 1 << n % 4 for n in nodes}, cell={int(n): int(n % 3) for n in nodes}), 0.7),
        (routing.Mirage([(0.0, 0.0, 0.0), (9.0, 9.0, 9.0), (4.0, 0.0, 9.0)], graphs, {int(n): int(n % 3) for n in nodes}, {(0, 1): 0.7}, most=3), 0.9),
    ]
    for policy, share in policies:
        want = list(routing.fold("x", sent, met, policy))
        run, looked = routing._Run("x", sent, policy, None, 1), []
        meet, run.meet = run.meet, lambda e: looked.append(e) or meet(e)  # noqa: B023
        lot, got = routing._Lookout(nodes, run), []
        for i in range(0, len(met), 700):
            part = met[i : i + 700]
            ends = np.searchsorted(nodes, [(e.node1, e.node2) for e in part])
            got += lot.through(np.array([e.time for e in part]), ends, np.ones(len(part)), np.array([(e.x, e.y, e.z) for e in part]))
        assert got == want and {x[1] for x in got} >= {"originate", "transfer", "load"} and len(looked) <= share * len(met), (policy, len(looked))


def test_fnv_in_batches_equals_the_fold(spark):
    texts = ["", "a", "foobar", "ä€𝄞", "0" * 300, None, "x" * 31] + [f"{i * 21600}.000000{i}{i * 7}" for i in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = df.select("text", scalars.fnv1a64_in_batches(F.col("text")).alias("h"), scalars.fnv1a64(F.col("text")).alias("plain")).collect()
    assert len(got) == len(texts) and all(x.h == x.plain and (x.h is None) == (x.text is None) for x in got)
    assert {x.text: x.h for x in got}["a"] == "12638187200555641996"
    plan = df.select(scalars.encounter_hash(F.lit(1.0), F.lit(1), F.length("text")))._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan


def test_conditions_bound_the_reach():
    near, coin = contacts.Condition("near", "distance", dist=2.0), contacts.Condition("coin", "probability", prob=0.5)
    assert contacts.reach_of([coin, near], 5.0) == 2.0 and contacts.reach_of([near], 1.0) == 1.0 and contacts.reach_of([coin], 5.0) == 5.0
