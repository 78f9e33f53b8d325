"""Experiments end to end on a small store."""

import json
import random

import pytest

from wayfare import experiment


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    r = random.Random(3)
    src = d / "src"
    src.mkdir()
    rows = []
    for node in range(8):
        x, y = r.uniform(0, 8), r.uniform(0, 8)
        for k in range(70):
            rows.append({"user": node, "simtime": 1000 + 10 * k + r.random(), "position": {"X": x, "Y": y, "Z": 0}})
            x, y = x + r.gauss(0, 1), y + r.gauss(0, 1)
    (src / "a.json").write_text(json.dumps(rows))
    experiment.import_dataset(spark, str(d), "simple", str(src), "toy")
    return str(d)


CONDITIONS = {"conditions": [{"name": "near", "type": "distance", "params": {"dist": 2.0}}]}


@pytest.mark.parametrize("logic,kind", [("broadcast", 0), ("randomwalk-v1", 1), ("mixed", 2), ("mirage", 3), ("addressing", 4)])
def test_every_logic(spark, root, logic, kind):
    s = experiment.read_settings(experiment.Settings, json.dumps({"simulation": {"experiment_name": f"e-{logic}", "dataset_name": "toy", "start_time": 1000, "end_time": 1700, "time_step": 20, "logic": logic, "message_generation_type": kind, "unused": 1}}))
    out = experiment.simulate(spark, root, s, experiment.Logic(districts_amount=3, kmeans_iterations=2, k=2, distance=4.0, gridsize=4.0), CONDITIONS, {"ttl_hops": 20, "ttl_time": 10000}).first()
    assert out.num_messages > 0 and (out.throughput is None or 0 <= out.throughput <= 1)
    if logic == "broadcast":
        assert out.throughput > 0 and out.net_load > 0 and out.peak_load > 0


def test_listing_and_families(spark, root):
    assert [r.dataset_name for r in experiment.list_datasets(spark, root).collect()] == ["toy"]
    assert experiment.family_results(spark, root).count() >= 1
    with pytest.raises(ValueError):
        experiment.policy_of(spark, root, experiment.Settings("x", "toy", logic="none"), experiment.Logic())
