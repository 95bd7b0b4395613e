"""Small fixtures for what recorded answers, pages and addresses become."""

import csv
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from threadloom.functions import ioc
from threadloom.functions import pages as P
from threadloom.operators import clusters, store
from threadloom.sources import providers
from threadloom.streaming import events


def test_technologies_and_wallets(spark):
    page = '<link href="/wp-content/a.css"><script src="/js/jQuery.min.js"></script> pay 0x' + "aB" * 20 + " or 1BoatSLRHtKNngkdXEeobR76b53LETtpyT, 0x12"
    rows = spark.createDataFrame([(page,), ("plain",), ("",)], "html string").select(P.technologies(F.col("html")).alias("t"), P.wallets(F.col("html")).alias("w")).collect()
    assert [r.t for r in rows] == [["jquery", "wordpress"], [], []]
    assert [r.w for r in rows] == [["0x" + "aB" * 20, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"], [], []]


def test_icon_hash_by_published_values(spark):
    assert [ioc.murmur3(x) for x in (b"", b"hello", b"hello, world")] == [0, 613153351, 345750399]
    rows = spark.createDataFrame([(b"x" * 100,), (None,)], "b binary").select(ioc.favicon_hash("b").alias("h")).collect()
    import base64

    assert [r.h for r in rows] == [ioc.murmur3(base64.encodebytes(b"x" * 100)), None]


def test_public_addresses(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "127.0.0.1": False, "169.254.1.1": False, "2001:4860:4860::8888": True, "[::1]": False, "fe80::1": False, "300.1.1.1": False, "host": False, "": False, None: False}
    rows = spark.createDataFrame([(v,) for v in cases], "v string").select("v", ioc.is_public_ip("v").alias("p")).collect()
    assert {r.v: r.p for r in rows} == cases


def test_archive_index(spark):
    rows = [("u", "20200101000000", "a"), ("u", "20220301123000", "b"), ("u", "20210101000000", "a"), ("u", "soon", None), ("v", None, None)]
    got = {r.url: r for r in providers.archive(spark.createDataFrame(rows, "url string, timestamp string, digest string")).collect()}
    assert (got["u"].snapshots, got["u"].versions, got["u"].first, got["u"].last) == (4, 2, datetime(2020, 1, 1), datetime(2022, 3, 1, 12, 30))
    assert (got["v"].snapshots, got["v"].versions, got["v"].first) == (1, 0, None)


def test_scan_results(spark):
    rows = [("t", "2.2.2.2", "AS2", "B", 5), ("t", "1.1.1.1", "AS2", None, 9), ("t", "1.1.1.1", None, "A", 7)]
    r = providers.scans(spark.createDataFrame(rows, "target string, ip string, asn string, title string, at int")).first()
    assert (r.scans, r.ips, r.asns, r.titles, r.first, r.last) == (3, ["1.1.1.1", "2.2.2.2"], ["AS2"], ["A", "B"], 5, 9)


def test_list_of_indicators(spark):
    lines = [(1, "# list"), (2, "  Example.com "), (3, ""), (4, "example.com"), (5, "8.8.8.8"), (6, "not an indicator"), (7, None)]
    got = providers.indicators(spark.createDataFrame(lines, "pos int, raw string"), ioc.parse_ioc).orderBy("pos").collect()
    assert [(r.pos, r.ioc.type, r.ioc.value) for r in got] == [(2, "domain", "example.com"), (5, "ip", "8.8.8.8")]


def test_related_entities_become_edges(spark):
    related = [("ip", "1.1.1.1", "RESOLVES_TO", False), ("domain", "b.example", "REDIRECTS_TO", True), ("ip", None, "RESOLVES_TO", False), ("ip", "2.2.2.2", "RESOLVES_TO", False)]
    runs = spark.createDataFrame([("o", "dns", related), ("p", "dns", [])], "origin string, provider string, related array<struct<type:string,value:string,relation:string,reverse:boolean>>")
    got = store.expand_facts(runs, 3).orderBy("value").collect()
    assert [(r.value, r.source == "o", r.target == "o") for r in got] == [("1.1.1.1", True, False), ("b.example", False, True)]


def test_urls_take_the_best_of_their_hosts(spark):
    edges = spark.createDataFrame([("h", "HAS_URL", "u"), ("g", "HAS_URL", "u"), ("h", "RESOLVES_TO", "v")], "source string, type string, target string")
    scores = spark.createDataFrame([("h", 40), ("g", 70)], "host string, score int")
    urls = spark.createDataFrame([("u", 50), ("v", 20), ("w", None)], "id string, confidence int")
    assert {r.id: r.confidence for r in clusters.url_confidence(scores, edges, urls).collect()} == {"u": 70, "v": 20, "w": 0}


def test_cells_of_a_written_file(spark, tmp_path):
    at = str(tmp_path / "out")
    store.write_csv(spark.createDataFrame([("=1+1", ["a", "b"], None), ("plain", [], 3)], "v string, tags array<string>, n int").coalesce(1), at)
    rows = [r for p in Path(at).glob("*.csv") for r in csv.DictReader(p.open())]
    assert sorted((r["v"], r["tags"], r["n"]) for r in rows) == [("'=1+1", "a b", ""), ("plain", "", "3")]


def test_sessions_end_after_a_pause(spark):
    rows = [("u", "2024-01-01 10:00:00"), ("u", "2024-01-01 10:20:00"), ("u", "2024-01-01 10:49:59"), ("u", "2024-01-01 11:30:00"), ("w", "2024-01-01 10:00:00")]
    got = events.sessions(spark.createDataFrame(rows, "username string, ts string")).collect()
    assert sorted((r.username, r.start.hour, r.start.minute, r.calls) for r in got) == [("u", 10, 0, 3), ("u", 11, 30, 1), ("w", 10, 0, 1)]
