"""Hamming search and upload matches against all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.operators import correlation, uploads


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance", [0, 1, 3, 6, 7, 8, 11, 12, 16])
def test_probe_plan_covers_every_difference(distance):
    """However distance flipped bits are spread over the blocks, one block has its radius or fewer."""
    plan = correlation.probe_plan(distance)
    assert sum(n for _, n, _ in plan) == 64 and sum(r + 1 for *_, r in plan) == distance + 1
    rng = random.Random(distance)
    for _ in range(3000):
        flipped = rng.sample(range(64), distance)
        assert any(sum(lo <= b < lo + n for b in flipped) <= r for lo, n, r in plan)


@pytest.mark.parametrize("distance", [0, 2, 7, 11])
def test_hamming_search(spark, distance):
    rng = random.Random(distance)
    stored = [rng.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]
    asked = [rng.getrandbits(64) for _ in range(5)] + [0]
    for h in stored[:150]:
        g = h
        for b in rng.sample(range(64), rng.randint(0, distance + 2)):
            g ^= 1 << b
        asked.append(g)
    want = {(signed(h), signed(g), (h ^ g).bit_count()) for h in stored for g in asked if (h ^ g).bit_count() <= distance}
    df = spark.createDataFrame([(signed(h),) for h in stored * 2] + [(None,)], "h long")
    got = [tuple(r) for r in correlation.hamming_search(df, spark.createDataFrame([(signed(g),) for g in asked * 2] + [(None,)], "g long"), distance).collect()]
    assert set(got) == want and len(got) == len(want)
    assert correlation.hamming_search(df.limit(0), df.select(F.col("h").alias("g")), distance).count() == 0


@pytest.mark.parametrize("distance", [6, 7, 8, 11])
def test_few_candidates(distance):
    """Of evenly spread hashes, less than half a hundredth of all pairs meet in a block."""
    from math import comb

    share = sum(sum(comb(n, k) for k in range(r + 1)) / 2**n for _, n, r in correlation.probe_plan(distance))
    assert share < 0.005


def test_nearest_pictures(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(6)]
    bent = lambda: rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 9)))
    rows = [(i, rng.choice([None, bent()]), rng.choice([None, [], [bent(), bent(), None]]), rng.choice([None, bent()]), bent()) for i in range(200)]
    rows += [(1000 + i, base[0], None, None, base[0]) for i in range(150)]  # one picture on many hosts
    asked = [(k, b) for k, b in enumerate(base)] + [(0, base[1]), (9, rng.getrandbits(63)), (10, None)]
    stored = uploads.pictures(spark.createDataFrame(rows, "id long, logo long, logos array<long>, favicon long, screenshot long"))
    for most in (5, 100):
        want = defaultdict(dict)
        for u, g in asked:
            for i, logo, logos, favicon, shot in rows:
                for rank, via, h in [(0, "logo", logo), *((0, "logo", x) for x in logos or []), (1, "favicon", favicon), (2, "screenshot", shot)]:
                    if h is not None and g is not None and (h ^ g).bit_count() <= 7:
                        want[u][i] = min(want[u].get(i, (99, 9, "")), ((h ^ g).bit_count(), rank, via))
        full = {(u, i, b[2], 1 - b[0] / 64, n) for u, m in want.items() for n, (i, b) in enumerate(sorted(m.items(), key=lambda x: (x[1][0], x[0]))[:most], 1)}
        got = {tuple(r) for r in uploads.nearest_pictures(stored, spark.createDataFrame(asked, "upload long, g long"), 0.88, most).collect()}
        assert got == full


def test_page_matches(spark):
    kinds = "long, trackers array<string>, title_hash string, html long"
    stored = spark.createDataFrame([(1, ["UA-1", "UA-2", ""], "t", 0), (2, ["UA-9"], "t", 0), (3, None, None, 1), (4, [], "x", None), (5, ["UA-2"], None, 12345678901)], f"id {kinds}")
    asked = spark.createDataFrame([(7, ["UA-2", "UA-1", "UA-2", ""], "t", 3), (8, None, None, None)], f"upload {kinds}")
    got = {(r.upload, r.id, r.via, r.similarity, tuple(r.shared)) for r in uploads.page_matches(stored, asked).collect()}
    assert got == {(7, 1, "tracking_id", 1.0, ("UA-1", "UA-2")), (7, 5, "tracking_id", 1.0, ("UA-2",)), (7, 2, "title", 1.0, ()), (7, 3, "structure", 1 - 1 / 64, ())}
    assert {(r.id, r.via) for r in uploads.page_matches(stored, asked, most=1).collect()} == {(1, "tracking_id"), (3, "structure")}


def test_page_matches_of_common_trackers_and_titles(spark):
    """Every upload shares two trackers and its title with thousands of assets: all are ranked, and few meet."""
    kinds = "trackers array<string>, title_hash string, html long"
    stored = spark.range(3000).select((2999 - F.col("id")).alias("id"), F.array(F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.when(F.col("id") % 5 == 0, "c")).alias("trackers"), F.concat(F.lit("t"), F.col("id") % 2).alias("title_hash"), F.lit(None).cast("long").alias("html"))
    asked = spark.createDataFrame([(u, ["b", "c", None, ""], "t0", None) for u in range(200)], f"upload long, {kinds}")
    df = uploads.page_matches(stored.unionByName(stored.limit(50)), asked, most=30)
    rows = [(r.id, [t for t in r.trackers if t in ("b", "c")], r.title_hash) for r in stored.collect()]
    tracked = sorted((i, t) for i, t, _ in rows if t)[:30]
    want = {i: ("tracking_id", tuple(sorted(t))) for i, t in tracked}
    got = df.collect()
    for u in range(200):
        mine = {r.id: (r.via, tuple(r.shared)) for r in got if r.upload == u}
        assert {k: v for k, v in mine.items() if v[0] == "tracking_id"} == want
    joined = [int(n) for n in rows_joined(df)]
    assert max(joined) < 100_000  # 340,000 of trackers and 300,000 of titles before


def rows_joined(df):
    """Output rows of the joins of the plan that ran last."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "JoinExec" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_brand_references(spark):
    rows = [(3, "Acme", True, 1), (1, "ACME", True, 2), (2, "acme", False, 3), (4, "other", True, 4)]
    assert [r.id for r in uploads.brand_references(spark.createDataFrame(rows, "id long, brand string, reference boolean, h long"), " aCme ").collect()] == [1, 3]
