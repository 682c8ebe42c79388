"""What the driver has to keep track of: jobs and tasks follow the rows, not the number of partitions."""

import contextlib
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.llm import graph, jaccard, quality

PARTS = 60


@contextlib.contextmanager
def many_partitions(spark):
    """PARTS shuffle partitions that aren't coalesced; yields what gives the numbers of tasks of each job since."""
    own = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")

    def tasks():
        tracker = sc.statusTracker()
        jobs = (tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group))
        return [sum(s.numTasks for s in map(tracker.getStageInfo, j.stageIds) if s) for j in jobs if j]

    try:
        yield tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_map_of_shared_tokens_takes_few_jobs(spark):
    sets = spark.createDataFrame([(i, 3, [i, 7, 1 << 62]) for i in range(20)], "id long, n long, prefix array<long>").repartition(2)
    shared = spark.createDataFrame([(7,), (1 << 62,), (-5,)], "token long")
    with many_partitions(spark) as tasks:
        found = jaccard.maybe_shared(sets, shared)
        jobs = len(tasks())
    assert 0 < jobs <= jaccard.MAP_PARTS + 4 < PARTS
    # the map tells tokens apart by their highest bits, so all small ones pass with 7
    assert {r["token"] for r in found.collect()} == {*range(20), 7, 1 << 62}
    assert not jaccard.maybe_shared(sets, shared.where("token < 0")).count()


def test_weights_are_fitted_in_partitions_by_the_number_of_pairs(spark):
    rows = [(i, [float((i * 7 + j) % 11) / 11 + (i % 2) * (j == 0) for j in range(len(quality.NAMES))]) for i in range(400)]
    features = spark.createDataFrame(rows, "id long, features array<double>").repartition(4)
    labels = features.select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    plain = quality.fit_features(features, labels)
    with many_partitions(spark) as tasks:
        weights, threshold = quality.fit_features(features, labels)
        found = tasks()
    assert len(found) > 10
    # few jobs shuffle, the iterations have a task each
    assert sum(n < PARTS for n in found) > 0.5 * len(found)
    assert weights == pytest.approx(plain[0], abs=1e-6) and threshold == pytest.approx(plain[1], abs=1e-6)


@pytest.mark.parametrize("most", [graph.BROADCAST_EDGES, 0])
def test_components_of_stars_need_no_round(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", most)
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 60)] + [(2, 2), (None, 1)], "a long, b long")
    with many_partitions(spark) as tasks:
        found = graph.components(stars)
        jobs = len(tasks())
    assert {(r["id"], r["component"]) for r in found.collect()} == {(i, i % 3) for i in range(3, 60)}
    assert jobs <= 6
    # a chain, a ring and a leaf of two hubs need rounds
    links = [(i, i + 1) for i in range(100, 140)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(300, 310), (301, 310)]
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(101, 141)} | {200 + i: 200 for i in range(1, 17)} | {301: 300, 310: 300}
