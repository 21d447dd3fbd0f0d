"""Components of links: the right ones, with few tasks however many shuffle partitions there are."""

import random

import pytest

from voxelframe.llm import _graph


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graph():
    random.seed(5)
    chain = random.sample(range(600), 600)
    hubs = [(5000, k) for k in range(4000, 4200)] + [(6000, k) for k in range(6001, 6200)]
    return [*zip(chain, chain[1:]), *hubs, (7000, 7001), (7001, 7000), (7001, 7001), (8000, 8000), (None, 1), (2, None)]


@pytest.fixture
def scattered(spark):
    """Many shuffle partitions that Spark doesn't coalesce itself."""
    conf = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_links_in_many_partitions_are_few_tasks(scattered):
    context = scattered.sparkContext
    links = scattered.createDataFrame(graph(), "a long, b long")
    context.setJobGroup("components", "")
    try:
        found = _graph.components(links)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.component for r in found.collect()} == brute(graph())
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("components") for s in seen.getJobInfo(j).stageIds}
    assert sum(seen.getStageInfo(s).numCompletedTasks for s in stages) < 600  # a task for each partition in each round are more


@pytest.mark.parametrize("rows", [40, 1 << 15])
def test_components_equal_brute_force_in_any_number_of_parts(scattered, monkeypatch, rows):
    monkeypatch.setattr(_graph, "ROWS", rows)
    found = _graph.components(scattered.createDataFrame(graph(), "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == brute(graph())
    assert _graph.components(scattered.createDataFrame([], "a long, b long")).isEmpty()
