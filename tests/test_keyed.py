"""Queries that work on the tables' keys in place of ids, on odd tables, against their SQL; and what they write."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from threadloom.operators import clusters, components, graph
from threadloom.plans import more, queries
from threadloom.sources import driver

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory, spark):
    """Ten blocks of suppliers and parts, a part of 200 suppliers, suppliers and parts that are missing, lines that repeat, a part of two types, a part twice, a type that is unknown or null."""
    d, rng = tmp_path_factory.mktemp("odd"), random.Random(5)
    kinds = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE", "OTHER", None]
    suppliers = [(k, f"s{k}", k % 7, float(k * 37 % 9000)) for k in range(1, 301) if k % 40 != 39]
    parts = [(p, kinds[p % 8]) for p in range(1, 101) if p != 33] + [(5, "LARGE"), (6, kinds[6])]
    lines = [(k, 1) for k in range(1, 201)] + [(k, 33) for k in range(20)] + [(299, 98), (300, 98), (299, 98), (2000, 99), (7, 99)]
    lines += [(rng.randint(0, 18) + 30 * b + 1, rng.randint(2, 8) + 10 * b) for b in range(10) for _ in range(rng.choice([12, 40, 80]))] * 2
    tables = {"supplier": (suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), "part": (parts, "p_partkey long, p_type string"), "lineitem": (lines, "l_suppkey long, l_partkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(d / f"{name}.parquet"))
    db = duckdb.connect()
    for name in ("nation", "region", "events"):
        (d / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return str(d), db


@pytest.mark.parametrize("name", ["operations", "cluster_summary", "cluster_breakdown", "cluster_edges", "case_scope", "rebuilt_clusters", "neighbour_sets"])
def test_as_its_sql_without_a_table_of_edges(spark, odd, monkeypatch, name):
    d, db = odd
    written = []

    def noted(df, table):
        written.append((table, df.count()))
        return df

    for module in (queries, more, components):
        monkeypatch.setattr(module, "materialise", lambda df, table, f=module.materialise: noted(f(df, table), table))
    df = e.queries()[name](spark, d)
    found = db.execute(e.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    want = sorted(tuple(r[i] for i in at) for r in found.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) > 3
    lines = spark.read.parquet(f"{d}/lineitem.parquet").distinct().count()
    assert "relationships" not in dict(written) and all(n < lines for _, n in written)


def test_operations_by_keys(spark, odd):
    d, _ = odd
    byid = graph.operations(driver.assets(spark, d), driver.relationships(spark, d), queries.DISTINCT)
    bykey = queries._operations(spark, d)
    assert sorted(tuple(r) for r in byid.collect()) == sorted(tuple(r) for r in bykey.select("host", "root", "n").collect())
    assert bykey.filter(driver.host_id(F.col("key")) != F.col("host")).isEmpty() and bykey.select("root").distinct().count() == bykey.select("group").distinct().count() == bykey.select("root", "group").distinct().count() > 3


def test_a_crowded_host_still_links(spark):
    """A target that is a host is not cut; one that is none is."""
    assets = spark.createDataFrame([(f"h{i}", "domain") for i in range(9)] + [("f", "favicon")], "id string, type string")
    edges = spark.createDataFrame([(f"h{i}", "T", "h8") for i in range(4)] + [(f"h{i}", "T", "f") for i in range(3, 8)], "source string, type string, target string")
    assert {r.host for r in graph.operations(assets, edges, ("T",), noisy_limit=3).collect()} == {"h0", "h1", "h2", "h3", "h8"}


@pytest.mark.parametrize("at_once,kept", [(1 << 19, 1 << 20), (40, 1 << 20), (40, 10)])
def test_forests(spark, monkeypatch, at_once, kept):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    monkeypatch.setattr(components, "KEPT", kept)
    rng = random.Random(at_once + kept)
    rows = [(rng.randrange(60) + 100 * b, rng.randrange(60) + 100 * b) for b in range(5) for _ in range(400)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3), (3, None)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        for kind in ("long", "string") if at_once > 40 else ("long",):
            edges = spark.createDataFrame(rows, "u long, v long").repartition(3).selectExpr(f"CAST(u AS {kind}) AS u", f"CAST(v AS {kind}) AS v")
            less = components.forests(edges)
            assert less.dtypes == edges.dtypes
            assert {tuple(r) for r in components.components(less).collect()} == {tuple(r) for r in components.components(edges.dropna()).collect()}
            if kept > 10:
                assert less.count() <= 3 * 361 < len(rows)
            one = components.forests(edges.filter("u < '1000'" if kind == "string" else "u < 60").repartition(1))
            assert kept <= 10 or one.groupBy("v").count().join(one.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and one.filter("u <= v").isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_carried(spark):
    rows = [(1, 10, "SHARES_FAVICON", 5), (1, 11, "SHARES_FAVICON", 5), (1, 10, "SHARES_LOGO", 5), (2, 12, "SHARES_FAVICON", 5), (1, 12, "USES_CERTIFICATE", 6), (1, 12, "USES_CERTIFICATE", 6), (1, 10, "SHARES_PIXEL", 7), (1, 11, "SHARES_PIXEL", 7)]
    got = {(r.group, r.key): (set(r.features), r.degree) for r in clusters.carried(spark.createDataFrame(rows, "group long, key long, type string, target long")).collect()}
    assert got == {(1, 10): ({"favicon", "pixel"}, 3), (1, 11): ({"favicon", "pixel"}, 2), (1, 12): (set(), 2), (2, 12): (set(), 1)}
