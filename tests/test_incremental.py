"""Clusters kept up to date against a rebuild after every batch."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.operators import incremental


def groups(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    out = defaultdict(set)
    for n in list(root):
        out[find(n)].add(n)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_rebuild_after_every_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    labels, tombstones = incremental.empty(spark)
    every, stood, ids = [], {}, set()
    path = f"{tmp_path}/labels"
    for batch in range(5):
        edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(9)] + [("n1", "n1")] * (batch == 2)
        every += edges
        df = spark.createDataFrame([*edges, *edges[:2], (None, "n5")], "u string, v string").repartition(3)
        added, tombstones = incremental.absorb(labels, tombstones, df, batch)
        new = {r.node for r in added.collect()}
        assert not new & ids and new <= {n for e in edges for n in e}
        ids |= new
        incremental.append_labels(added, path)
        labels = spark.read.schema(incremental.LABELS).parquet(path)
        rows = incremental.current(labels, tombstones).collect()
        by = defaultdict(set)
        for r in rows:
            by[r.cluster].add(r.node)
        assert {frozenset(g) for g in by.values()} == groups(every) and len(rows) == len({r.node for r in rows})
        now = {r.node: r.cluster for r in rows}
        for cluster in set(stood.values()):  # an id that stood stays, or leads to one that stood
            to = {now[n] for n in stood if stood[n] == cluster}
            assert len(to) == 1 and to <= set(stood.values())
        stood = now
    assert tombstones.count() > 0 and not {r.survivor for r in tombstones.collect()} & {r.old for r in tombstones.collect()}


def test_only_buckets_of_new_ends_are_read(spark, tmp_path):
    path = f"{tmp_path}/labels"
    edges = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(400)], "u string, v string")
    added, tombstones = incremental.absorb(*incremental.empty(spark), edges, 0)
    incremental.append_labels(added, path)
    labels = spark.read.schema(incremental.LABELS).parquet(path)
    ends = spark.createDataFrame([("a1",), ("zz",)], "node string").withColumn("bucket", incremental.bucket())
    looked = incremental.looked_up(labels, ends)
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert [r.node for r in looked.collect()] == ["a1"] and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET) ", plan)
    more, after = incremental.absorb(labels, tombstones, spark.createDataFrame([("a1", "a2"), ("zz", "a3")], "u string, v string"), 1)
    assert [(r.node, r.cluster) for r in more.collect()] == [("zz", "a3")] and [(r.old, r.survivor) for r in after.collect()] == [("a2", "a1")]


def test_saved(spark):
    kinds = "created_at int, confidence int, evidence map<string,int>, members array<string>"
    old = spark.createDataFrame([("k2", 2, 90, {"x": 1, "y": 5}, ["a", "b"]), ("k1", 1, 10, {"x": 9}, ["c"]), ("k3", 3, 80, None, ["f"]), ("k4", 4, 5, {"q": 1}, ["z"])], f"id string, {kinds}")
    found = spark.createDataFrame([("new1", 9, 50, {"x": 3}, ["b", "c", "d"]), ("new2", 9, 60, {"w": 1}, ["f", "g"]), ("new3", 9, 7, None, ["h"])], f"key string, {kinds}")
    got = {r.id: (r.created_at, r.confidence, r.evidence, r.members) for r in incremental.saved(old, found).collect()}
    assert got == {"k1": (1, 50, {"x": 9}, ["a", "b", "c", "d"]), "k3": (3, 80, {"w": 1}, ["f", "g"]), "new3": (9, 7, {}, ["h"]), "k4": (4, 5, {"q": 1}, ["z"])}
