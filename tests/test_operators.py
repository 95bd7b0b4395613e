import pytest
from pyspark.sql import functions as F

from threadloom.config import Scoring
from threadloom.operators import catalog, correlation, graph, history, store
from threadloom.sources import providers
from threadloom.streaming import events

EDGE = "id string, source string, type string, target string"


def edges(spark, rows):
    return spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], EDGE)


@pytest.fixture(scope="module")
def world(spark):
    """A seed, a twin that shares all, a weak neighbour, and one that shares only a crowded favicon."""
    a = [("s", "domain", "seed.test"), ("t", "domain", "twin.test"), ("w", "domain", "weak.test"), ("n", "domain", "noisy.test"), ("ga", "analytics", "UA-1"), ("gtm", "tracking", "GTM-A"), ("fav", "favicon", "1"), ("c", "certificate", "c"), ("i", "ip", "192.0.2.1"), ("as", "asn", "AS1")]
    e = [("s", "SHARES_ANALYTICS", "ga"), ("t", "SHARES_ANALYTICS", "ga"), ("s", "SHARES_TRACKING", "gtm"), ("t", "SHARES_TRACKING", "gtm"), ("s", "USES_CERTIFICATE", "c"), ("t", "USES_CERTIFICATE", "c"),
         ("s", "RESOLVES_TO", "i"), ("w", "BELONGS_TO_ASN", "as"), ("i", "BELONGS_TO_ASN", "as"), ("s", "SHARES_FAVICON", "fav"), ("n", "SHARES_FAVICON", "fav"), ("x1", "SHARES_FAVICON", "fav")]
    return spark.createDataFrame(a, "id string, type string, value string"), edges(spark, e)


def test_correlation(spark, world):
    seeds = spark.createDataFrame([("s",)], "host string")
    got = {r.host: (r.score, r.features, r.level) for r in correlation.correlate(*world, seeds, Scoring(noisy_limit=2).merged(favicon=10.0)).collect()}
    assert got["s"][0] == 100 and got["t"] == (100, "analytics=40.00,gtm=40.00,certificate=25.00", "Very High")
    assert got["w"] == (5, "asn=5.00", "Informational") and got["n"][:2] == (2, "favicon=2.50") and got["i"][0] == 5


def test_graph(spark, world):
    assets, e = world
    assert {r.id for r in graph.restrict(e, assets).filter("target = 'fav'").collect()} == {"e9", "e10"}
    assert {(r.id, r.hops) for r in graph.neighbourhood(e, spark.createDataFrame([("w",)], "id string"), 2).collect()} == {("w", 0), ("as", 1), ("i", 2)}
    assert {r.host for r in graph.operations(assets, e, ("SHARES_ANALYTICS", "SHARES_FAVICON"), noisy_limit=2).collect()} == {"s", "t"}
    hops = edges(spark, [("u1", "REDIRECTS_TO", "u2"), ("u3", "REDIRECTS_TO", "u2"), ("h1", "HAS_URL", "u1"), ("h3", "HAS_URL", "u3"), ("h9", "HAS_URL", "u9")])
    assert {r.host for r in graph.redirect_hosts(hops, spark.createDataFrame([("u1",)], "id string")).collect()} == {"h1", "h3"}
    assert graph.density(assets, e).first().n == 10 and graph.shared_neighbours(e, "s", "t").count() == 3


def test_hamming_links(spark):
    rows = [(1, 0), (2, 0b111), (3, -1), (4, -1 << 3), (5, 0)]
    got = {(r.a, r.b, r.bits) for r in correlation.hamming_links(spark.createDataFrame(rows, "id long, h long"), 3).collect()}
    assert got == {(1, 2, 3), (1, 5, 0), (3, 4, 3)}  # 5 is linked to 1, which stands for both


def test_clusters_merge(spark):
    d = spark.createDataFrame([("a", 2, ["x", "y"]), ("b", 1, ["y", "z"]), ("c", 3, ["q"])], "id string, created_at long, members array<string>")
    assert {(r.id, tuple(r.members)) for r in correlation.merge_clusters(d).collect()} == {("b", ("x", "y", "z")), ("c", ("q",))}


def test_catalog_rejects_other_sorts(spark, world):
    with pytest.raises(ValueError):
        catalog.page(world[0], "password")
    assert catalog.missing(spark.createDataFrame([("s",), ("zz",)], "id string"), world[0]).first().id == "zz"


def test_upserts(spark):
    rows = [("e", "a", "T", "b", i, f"v{i}") for i in range(30)] + [("loop", "a", "T", "a", 1, "x")]
    (r,) = store.upsert_edges(spark.createDataFrame(rows, "id string, source string, type string, target string, moment long, evidence string").withColumnRenamed("moment", "at")).collect()
    assert r.evidence == [f"v{i}" for i in range(10, 30)] and (r.first_seen, r.last_seen) == (0, 29)


def test_streaks(spark):
    d = spark.createDataFrame([("p", i, i, ok) for i, ok in enumerate([False] * 5 + [True, False])], "provider string, event_id long, moment long, ok boolean")
    assert [r.health for r in history.streaks(d, "provider").orderBy("event_id").collect()] == ["degraded"] * 4 + ["down", "healthy", "degraded"]


def test_providers(spark):
    record = "Registrar: REDACTED FOR PRIVACY\nRegistrar: Names Inc.\nCreation Date: 2020-01-01\nName Server: NS2.Example.test.\nName Server: ns1.example.test\nDomain Status: ok"
    r = providers.whois(spark.createDataFrame([(record,)], "text string")).first()
    assert (r.registrar, r.created, r.nameservers, r.statuses, r.private) == ("Names Inc.", "2020-01-01", ["ns1.example.test", "ns2.example.test"], ["ok"], True)
    r = providers.routing(spark.createDataFrame([("64500 64501 | 192.0.2.0/24 | US | arin | ",)], "text string")).first()
    assert (r.asn, r.prefix, r.allocated) == ("AS64500", "192.0.2.0/24", None)
    d = spark.createDataFrame([("a.test", 1, "a.test\n*.x.a.test b.test", "2024", "CA")], "base string, id long, name_value string, not_before string, issuer string")
    assert {(r.name, r.subdomain) for r in providers.certificate_names(d).collect()} == {("x.a.test", True), ("b.test", False)}
    assert providers.certificate_summary(d).first().issuers == ["CA"]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 10} 0{i % 10}:00:00", "p" if i % 2 else "q", i % 3 > 0) for i in range(30)]
    d = spark.createDataFrame(rows, "event_id long, ts string, provider string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = events.daily(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.provider, r.day, r.calls, r.errors) for r in events.daily(d).collect()}
    assert {(r.provider, r.day, r.calls, r.errors) for r in spark.table("daily").collect()} == want
    spark.conf.set(*events.STATE_STORE)
    q = events.failure_state(stream, down_at=2).writeStream.outputMode("update").format("memory").queryName("health").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.provider, r.failures, r.health) for r in spark.table("health").collect()} == {("p", 0, "healthy"), ("q", 0, "healthy")}
    spark.conf.unset(events.STATE_STORE[0])
