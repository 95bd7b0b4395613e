"""Ranks, bounded expansion, public suffixes and pivots against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.operators import expansion, pivots, suffixes
from threadloom.operators.graph import EXPANSION, NOT_EXPANDED


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1, 2, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    order = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=order), 1)}
    assert {r.i: r["rank"] for r in expansion.ranked(df, [F.desc_nulls_last("v"), F.col("i")]).collect()} == want
    within = {r[2]: n for g in {r[0] for r in rows} for n, r in enumerate(sorted((x for x in rows if x[0] == g), key=order), 1)}
    assert {r.i: r["rank"] for r in expansion.ranked(df, [F.desc_nulls_last("v"), F.col("i")], "g").collect()} == within
    assert expansion.ranked(df.limit(0), [F.col("i")]).count() == 0


def expanded(edges, seeds, budget, depth, quota):
    pairs = defaultdict(int)
    for s, t, kind in edges:
        if s != t and kind not in NOT_EXPANDED:
            for a, b in ((s, t), (t, s)):
                pairs[a, b] += EXPANSION.get(kind, 2)
    taken = {s: (0, 0, None, s) for s in sorted(set(seeds))[:budget]}
    for hop in range(1, depth + 1):
        met = defaultdict(list)
        for (a, b), w in pairs.items():
            if a in taken and taken[a][0] == hop - 1 and b not in taken:
                met[b].append((-w, a))
        if len(taken) >= budget:
            break
        found = [(-sum(-w for w, _ in ws), b, min(ws)[1]) for b, ws in met.items()]
        by = defaultdict(list)
        for f in sorted(found):
            by[taken[f[2]][3]].append(f)
        left = budget - len(taken)
        for w, b, via in sorted(f for fs in by.values() for f in fs[: quota if quota is not None else len(fs)])[:left]:
            taken[b] = (hop, -w, via, taken[via][3])
    return taken


@pytest.mark.parametrize("budget,depth,quota", [(1, 2, None), (9, 2, None), (30, 3, 3), (500, 2, 4), (500, 3, None), (0, 1, None)])
def test_expand_at_any_partitioning(spark, budget, depth, quota):
    rng = random.Random(4)
    kinds = [*EXPANSION, *NOT_EXPANDED, "OTHER"]
    edges = [(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}", rng.choice(kinds)) for _ in range(110)] + [("n00", f"leaf{i:03}", "SHARES_FAVICON") for i in range(50)]
    seeds = ["n00", "n07", "n33", "nowhere"]
    df = spark.createDataFrame(edges, "source string, target string, type string")
    want = expanded(edges, seeds, budget, depth, quota)
    for parts in (1, 6):
        got = expansion.expand(df.repartition(parts), spark.createDataFrame([(s,) for s in seeds * 2], "id string").repartition(parts), budget, depth, quota).collect()
        assert {r.id: (r.hops, r.strength, r.via, r.seed) for r in got} == want and len(got) == len(want)


def test_load_and_payload(spark):
    assets = spark.createDataFrame([("a", "domain", "a.com"), ("b", "ip", None), ("c", "ip", "1.1.1.1"), ("d", "asn", "AS1")], "id string, type string, value string")
    edges = spark.createDataFrame([("1", "a", "b", "RESOLVES_TO"), ("2", "a", "b", "OBSERVED_WITH"), ("3", "a", "a", "X"), ("4", "c", "d", "X")], "id string, source string, target string, type string")
    nodes, kept = expansion.load(assets, edges, spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",), ("zz",)], "id string"), 3)
    shown, drawn, stats = expansion.payload(nodes, kept, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert {(r.id, r.label, r.degree, r.focus) for r in shown.collect()} == {("a", "a.com", 4, True), ("b", "b", 2, False), ("c", "1.1.1.1", 0, False)}
    assert {(r.id, r.weight) for r in drawn.collect()} == {("1", 8), ("2", 5), ("3", 2)}
    assert [tuple(r) for r in stats.select("nodes", "edges", "kinds", "density").collect()] == [(3, 3, 2, 0.33333)]
    assert [tuple(r) for r in expansion.payload(nodes.limit(0), kept.limit(0))[2].collect()] == [(0, 0, 0, 0.0)]
    assert {r.id for r in expansion.highlighted(edges, spark.createDataFrame([("b",), ("d",)], "id string")).collect()} == {"a", "b", "c", "d"}


def test_difference(spark):
    kinds = "id string, n int, tags array<string>"
    old = spark.createDataFrame([("same", 1, ["a"]), ("gone", 1, None), ("twice", 1, None), ("twice", 2, None), ("null", None, None), ("less", 1, None), ("less", 1, None), (None, 1, None)], kinds)
    new = spark.createDataFrame([("same", 1, ["a"]), ("come", 1, None), ("twice", 2, None), ("twice", 1, None), ("null", 0, None), ("less", 1, None), (None, 2, None)], kinds)
    got = {r.id: r.change for r in expansion.difference(old, new).collect()}
    assert got == {"gone": "removed", "come": "added", "null": "changed", "less": "changed", None: "changed"}
    with pytest.raises(ValueError):
        expansion.difference(old, new.drop("n"))
    merged = expansion.merged_payload(old.filter("id = 'same'"), new.withColumn("n", F.lit(9)))
    assert {(r.id, r.n) for r in merged.filter("id IN ('same', 'come')").collect()} == {("same", 1), ("come", 9)}


LIST = ["// c", "com", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "com"]


@pytest.mark.parametrize("host,want", [
    ("www.Shop.com", "shop.com"), ("shop.com.", "shop.com"), ("com", "com"), ("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("x.uk", "x.uk"), ("a.b.c.kawasaki.jp", "b.c.kawasaki.jp"), ("c.kawasaki.jp", "c.kawasaki.jp"),
    ("x.city.kawasaki.jp", "city.kawasaki.jp"), ("city.kawasaki.jp", "city.kawasaki.jp"), ("kawasaki.jp", "kawasaki.jp"), ("a.www.ck", "www.ck"), ("a.b.ck", "a.b.ck"), ("z.a.b.ck", "a.b.ck"), ("deep.host.unknown", "deep.host.unknown"), ("", ""), (None, None),
])
def test_registrable(spark, host, want):
    got = suffixes.registrable(spark.createDataFrame([(host,), (host,)], "host string"), suffixes.rules(spark, LIST)).collect()
    assert [(r.host, r.registrable) for r in got] == [(host, want)]


def test_known_infrastructure(spark):
    assert len(set(suffixes.KNOWN_INFRASTRUCTURE)) == 41
    rows = [(x,) for x in ("cdn.cloudflare.com", "google.com", "notgoogle.com", "google.com.evil.com", "user.github.io", None, "x.test")]
    got = {r.value for r in suffixes.without_known(spark.createDataFrame(rows, "value string"), suffixes.rules(spark)).collect()}
    assert got == {"notgoogle.com", "google.com.evil.com", None, "x.test"}


def test_pivots(spark):
    seeds = spark.createDataFrame([("s1", "C256", "C1", "77", None, "Title", ["t1", "", "t3", "t4", "t5", "t6"]), ("s2", None, "", None, "F", None, None)], "seed string, cert_sha256 string, cert_sha1 string, favicon_mmh3 string, favicon_sha256 string, title string, tracking_ids array<string>")
    asked = pivots.asked(seeds)
    assert {tuple(r) for r in asked.collect()} == {("s1", "cert_sha256", "C256", "C256"), ("s1", "cert_sha1", "C1", "C256"), ("s1", "favicon_mmh3", "77", "77"), ("s1", "title", "Title", None), ("s1", "tracking_id", "t1", "t1"), ("s1", "tracking_id", "t3", "t3"), ("s1", "tracking_id", "t4", "t4"), ("s1", "tracking_id", "t5", "t5"), ("s2", "favicon_sha256", "F", None)}
    able = spark.createDataFrame([("b", ["title", "title", "cert_sha1"], True, False, 1, "x"), ("a", ["title"], True, True, 1, "y"), ("c", ["title"], False, False, 0, "x"), ("d", ["title"], True, False, 0, "y")], "name string, types array<string>, enabled boolean, credit boolean, priority int, category string")
    assert {(r.kind, r.provider) for r in pivots.fan_out(asked, able).collect()} == {("title", "b"), ("title", "a"), ("title", "d"), ("cert_sha1", "b")}
    assert {(r.kind, r.provider) for r in pivots.fan_out(asked, able, ["a", "b"], credits=False).collect()} == {("title", "b"), ("cert_sha1", "b")}
    assert [r.name for r in pivots.eligible(able, "title").orderBy("place").collect()] == ["d", "a", "b"]
    assert [r.name for r in pivots.eligible(able, "title", exclude=["d"], credits=False).collect()] == ["b"] and [r.name for r in pivots.eligible(able, "title", names=["a", "c"]).collect()] == ["a"]
    assert [r.name for r in pivots.eligible(able, "title", category="y").orderBy("place").collect()] == ["d", "a"]


def test_credits(spark):
    rows = spark.createDataFrame([(3, None), (9, True), (9, False), (5, None)], "n int, down boolean")
    got = rows.select(pivots.credits_allowed("when_needed", F.col("n"), 5, F.col("down")), pivots.credits_allowed("always", F.col("n"), 5), pivots.credits_allowed("never", F.col("n"), 5)).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (True, True, False), (False, True, False), (False, True, False)]
    with pytest.raises(ValueError):
        pivots.credits_allowed("sometimes", F.col("n"), 5)


def test_attached(spark):
    sent = spark.createDataFrame([("s1", "seed.com", "cert_sha1", "C1", "C256", "p"), ("s1", "seed.com", "title", "T", None, "p"), ("s2", "other.com", "favicon_sha256", "F", "missing", "q")], "seed string, seed_value string, kind string, value string, node_value string, provider string")
    hits = [("domain", "new.com", "SHARES_CERTIFICATE"), ("domain", "seed.com", "R"), ("domain", "not a domain", "R"), ("domain", "x.google.com", "R"), ("ip", "1.2.3.4", "R"), ("ip", "", "R"), ("ip", None, "R")]
    many = [("ip", f"10.0.{i // 250}.{i % 250}", "R") for i in range(200)]
    answers = spark.createDataFrame([("cert_sha1", "C1", "p", hits), ("title", "T", "p", many), ("favicon_sha256", "F", "q", hits[:2]), ("title", "else", "p", hits)], "kind string, value string, provider string, related array<struct<type:string,value:string,relation:string>>")
    assets = spark.createDataFrame([("n2", "certificate", "C256"), ("n1", "certificate", "C256"), ("n0", "favicon", "C256")], "id string, type string, value string")
    got = [(r.value, r.relation, r.target, r.provider, r.pivot) for r in pivots.attached(sent, answers, assets, suffixes.rules(spark)).collect()]
    assert len(got) == len(set(got)) == 154
    assert {g for g in got if g[4] != "title"} == {("new.com", "SHARES_CERTIFICATE", "n1", "p", "cert_sha1"), ("1.2.3.4", "R", "n1", "p", "cert_sha1"), ("new.com", "SHARES_CERTIFICATE", "s2", "q", "favicon_sha256"), ("seed.com", "R", "s2", "q", "favicon_sha256")}
    assert {g[0] for g in got if g[4] == "title"} == {v for _, v, _ in many[:150]} and {g[2] for g in got if g[4] == "title"} == {"s1"}


def test_attached_to_a_shared_node(spark):
    """Forty seeds of one certificate: their answers are one, and an entity is dropped only where it is the only seed."""
    seeds = [(f"s{i}", f"seed{i}.com", "cert_sha256", "C", "C", "p") for i in range(40)] + [("t", "only.com", "cert_sha256", "D", "D", "p"), ("u", None, "cert_sha256", "E", "E", "p"), ("v", "v.com", "cert_sha256", "E", "E", "p"), ("w", "w.com", "title", "C", None, "p")]
    sent = spark.createDataFrame(seeds, "seed string, seed_value string, kind string, value string, node_value string, provider string")
    hits = [("domain", x, "R") for x in ("seed0.com", "only.com", "v.com", "w.com")] + [("ip", f"10.0.0.{i}", "R") for i in range(100)]
    answers = spark.createDataFrame([("cert_sha256", v, "p", hits) for v in "CDE"] + [("title", "C", "p", hits)], "kind string, value string, provider string, related array<struct<type:string,value:string,relation:string>>")
    assets = spark.createDataFrame([(f"n{v}", "certificate", v) for v in "CDE"], "id string, type string, value string")
    df = pivots.attached(sent, answers, assets, suffixes.rules(spark))
    got = {(r.target, r.value) for r in df.collect() if r.type == "domain"}
    names = {"seed0.com", "only.com", "v.com", "w.com"}
    assert got == {("nC", v) for v in names} | {("nD", v) for v in names - {"only.com"}} | {("nE", v) for v in names} | {("w", v) for v in names - {"w.com"}}
    assert max(rows_made(df)) < 1000  # 4,472 with an answer for each seed


def rows_made(df):
    """Output rows of the nodes of the plan that ran last that multiply rows."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if name == "GenerateExec":
            found.append(node.metrics().apply("numOutputRows").value())
    return found


def test_infrastructure(spark):
    resolved = spark.createDataFrame([("h", ["1", "2", "3", "4"], ["6", "1"]), ("none", None, None)], "host string, a array<string>, aaaa array<string>")
    routes = spark.createDataFrame([("1", "AS2", "b", None), ("2", "AS1", "a", "DE"), ("3", "AS2", None, "FR"), ("4", "AS9", "z", "XX")], "ip string, asn string, hosting string, country string")
    got = {r.host: tuple(r)[1:] for r in pivots.infrastructure(resolved, routes).collect()}
    assert got == {"h": (["1", "2", "3", "4", "6"], ["AS1", "AS2"], ["a", "b"], "DE"), "none": ([], [], [], None)}
