import os
from random import Random

import pytest
from pyspark.sql import functions as F

from threadloom.config import Scoring
from threadloom.functions import brand
from threadloom.functions import text as X
from threadloom.operators import clusters, correlation, graph, history, profiles, report
from threadloom.operators.components import components
from threadloom.spark import discard, materialise, scratch


def column(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_skeleton_and_brand_words(spark):
    got = [r.s for r in column(spark, "раypa1", "rnicros0ft", "G00gle-4", "").select(brand.skeleton(F.col("v")).alias("s")).collect()]
    assert got == ["paypal", "microsoft", "googlea", ""]
    rows = column(spark, "The Bank of Fjord Inc", "inc", None).select(brand.brand_tokens(F.col("v")).alias("t"), brand.primary_token(F.col("v")).alias("p")).collect()
    assert [(r.t, r.p) for r in rows] == [(["bank", "fjord"], "fjord"), ([], None), ([], None)]
    titles = column(spark, "Login | Fjord Bank | Oslo Norway", "Fjord: home of banking", "plain", None)
    assert [r.b for r in titles.select(brand.infer_brand(F.lit(None).cast("string"), F.col("v")).alias("b")).collect()] == ["Fjord Bank", "Fjord", None, None]
    assert titles.limit(1).select(brand.infer_brand(F.lit("@acme "), F.col("v")).alias("b")).first().b == "acme"


def test_labels_in_punycode_and_with_accents(spark):
    """Decoding against the standard library's, and what is left of letters with marks, ligatures, full-width and mathematical forms."""
    random = Random(5)
    words = ["".join(random.choice("abcrn01éàöñçłазбуканοα漢字한글😀-") for _ in range(random.randint(1, 18))) for _ in range(400)]
    coded = {w: "xn--" + w.encode("punycode").decode() for w in words if not w.isascii()}
    got = {r.v: r.u for r in column(spark, *coded.values()).select("v", brand.unicode_label(F.col("v")).alias("u")).collect()}
    assert all(got[c] == w for w, c in coded.items())
    malformed = ["xn--", "xn--abc-", "xn--99999999", "xn--zzzzzzzzzzzzzz", "xn--a_b-1", "xn--" + "straße".encode("punycode").decode(), "plain", "", None]
    assert all(r.v == r.u for r in column(spark, *malformed).select("v", brand.unicode_label(F.col("v")).alias("u")).collect())
    cases = {"xn--pypal-4ve": "paypal", "Crédit-Agricolé": "creditagricole", "ﬁnance": "finance", "ｐａｙ": "pay", "r\u0301n": "m", "𝐩𝐚𝐲": "pay", "漢字": "", None: None}
    assert {r.v: r.s for r in column(spark, *cases).select("v", brand.skeleton(F.col("v")).alias("s")).collect()} == cases


def test_brand_assessment(spark):
    no, none = F.lit(False), F.lit(None).cast("string")

    def of(host, own=none, login=no, active=True, inferred=False, name="PayPal", logo=0.0):
        c = brand.assess(F.lit(host), F.lit(name), F.lit("PayPal login"), F.lit("paypal paypal"), none, own, F.lit(logo), login, F.lit(0), F.lit(0), no, no, F.lit(active), F.lit(inferred))
        return tuple(spark.range(1).select(c.alias("c")).first().c)

    assert of("www.paypal.com", F.lit("paypal.com")) == (True, 66, 0)
    assert of("paypa1-login.net", F.lit("paypal.com"), F.lit(True)) == (False, 66, round(33 + 15 + 5 + 3 + 10))
    assert of("paypa1-login.net", F.lit("paypal.com"), F.lit(True), active=False)[2] == round(66 * 0.6)
    assert of("shop.example", logo=1.0)[1] == 20 + 6 + 25
    assert of("paypal.net", inferred=True)[2] == round(0.5 * 3)
    assert of("shop.net", name="inc")[1:] == (0, 3)


def test_content_networks_and_common_nameservers_are_damped(spark):
    assets = spark.createDataFrame([(k, "domain", k) for k in "sabc"] + [("n", "asn", "AS13335"), ("m", "asn", "AS7"), ("i", "ip", "192.0.2.1"), ("g", "hosting", "g"), ("d", "nameserver", "x.awsdns-3.org"), ("e", "nameserver", "ns.own.example")], "id string, type string, value string")
    rows = [("s", "BELONGS_TO_ASN", "n"), ("s", "RESOLVES_TO", "i"), ("s", "HOSTED_ON", "g"), ("s", "USES_NAMESERVER", "d"), ("s", "USES_NAMESERVER", "e"), ("a", "BELONGS_TO_ASN", "n"), ("a", "RESOLVES_TO", "i"), ("b", "HOSTED_ON", "g"), ("b", "USES_NAMESERVER", "d"), ("c", "USES_NAMESERVER", "d"), ("c", "USES_NAMESERVER", "e")]
    edges = spark.createDataFrame(rows, "source string, type string, target string")
    out = {r.host: r.features for r in correlation.correlate(assets, edges, spark.createDataFrame([("s",)], "host string")).collect()}
    assert out == {"s": "", "a": "ip=2.50,asn=1.20", "b": "hosting=1.20,nameserver=1.20", "c": "nameserver=5.00"}


def test_profile_evidence(spark):
    rows = [("s", "shop.com", "Fjord Bank | Home", 0), ("a", "m.shop.com", "fjord bank home!", 63), ("b", "other.net", "Fjord Bank Homes", 127), ("c", "third.net", "Login", None), ("d", "x.net", None, -1), ("e", "e.net", "Nothing alike here", None)]
    looks = spark.createDataFrame(rows, "host string, value string, title string, html long").select("host", F.lit("domain").alias("type"), "value", "title", "html", F.lit(None).cast("long").alias("screenshot"), F.lit(None).cast("long").alias("logo"))
    links = [("s", "HAS_URL", "u1"), ("u1", "REDIRECTS_TO", "u2"), ("c", "HAS_URL", "u2"), ("d", "SHARES_CERTIFICATE", "s"), ("e", "SUBDOMAIN_OF", "s")]
    edges = spark.createDataFrame(links, "source string, type string, target string")
    got = {(r.host, r.feature): r.weight for r in profiles.profile_evidence(looks, edges, spark.createDataFrame([("s",)], "host string")).collect()}
    assert got == {("a", "subdomain"): 30, ("a", "title"): 15, ("a", "html"): 20, ("b", "title"): 14.1, ("c", "redirect"): 35, ("d", "certificate"): 25, ("e", "subdomain"): 30}
    assert {(r.host, r.via) for r in profiles.page_matches(looks, spark.createDataFrame([("s",)], "host string")).collect()} == {("a", "title")}


def test_hamming_links_against_all_pairs(spark):
    hashes = [(i, h) for i, h in enumerate([0, 0, 1, 3, 127, 255, -1, -1, -2, 1 << 62, (1 << 62) | 7, 12345, 0])]
    got = {(r.a, r.b): r.bits for r in correlation.hamming_links(spark.createDataFrame(hashes, "id long, h long"), 6).collect()}
    least = {h: min(i for i, x in hashes if x == h) for _, h in hashes}
    want = {(least[h], i): 0 for i, h in hashes if least[h] != i}
    far = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    want |= {(i, j): far(x, y) for x, i in least.items() for y, j in least.items() if i < j and far(x, y) <= 6}
    assert got == want
    with pytest.raises(ValueError):
        correlation.hamming_links(spark.createDataFrame(hashes, "id long, h long"), 8)


def test_success_clears_the_throttle(spark):
    runs = spark.createDataFrame([(1, "u", 0, False), (2, "u", 10, False), (3, "u", 20, True), (4, "u", 30, False), (5, "u", 2000, False)], "event_id int, username string, moment long, ok boolean")
    assert [r.recent for r in history.throttled(runs).orderBy("event_id").collect()] == [1, 2, 0, 1, 1]


def test_numbers_go_on_over_buckets(spark):
    rows = [(i, "k" if i % 3 else None, None if i % 7 == 0 else i % 5) for i in range(60)]
    out = history.numbered(spark.createDataFrame(rows, "id int, k string, b int"), ["k"], "b", ["id"]).collect()
    for key in ("k", None):
        mine = sorted((r for r in out if r.k == key), key=lambda r: (-1 if r.b is None else r.b, r.id))
        assert [r.number for r in mine] == list(range(1, len(mine) + 1))


def test_stages(spark):
    rows = [(1, "a", "collection", 1, "running", 140), (2, "a", "collection", 2, "completed", None), (3, "a", "pivot", 3, "failed", -4), (4, "b", "collection", 1, "failed", 20), (5, "b", "pivot", 1, "skipped", None), (6, "c", "pivot", 9, "running", 33)]
    states = history.stage_states(spark.createDataFrame(rows, "event_id int, investigation string, stage string, moment long, status string, progress int"))
    assert {(r.investigation, r.stage): (r.status, r.progress, r.runs) for r in states.collect()} == {("a", "collection"): ("completed", 100, 2), ("a", "pivot"): ("failed", 0, 1), ("b", "collection"): ("failed", 20, 1), ("b", "pivot"): ("skipped", 100, 1), ("c", "pivot"): ("running", 33, 1)}
    assert {(r.investigation, r.status, r.progress) for r in history.overall_status(states).collect()} == {("a", "completed", 50), ("b", "failed", 60), ("c", "running", 33)}


def test_cluster_of_one_is_none_and_confidence_falls_back(spark):
    scores = spark.createDataFrame([("s", 100), ("a", 40)], "host string, score int")
    seeds = spark.createDataFrame([("s",)], "host string")
    assert clusters.members(scores).count() == 0
    found = clusters.members(scores, Scoring(cluster_min=30))
    assert found.count() == 2 and clusters.confidence(found, seeds).first().confidence == 40
    assert clusters.confidence(found.filter("host = 's'"), seeds).first().confidence == 50


def test_view_drops_nodes_without_edges_only_where_hosts_are_chosen(spark):
    assets = spark.createDataFrame([("h", "domain", 80, False), ("r", "domain", None, True), ("l", "domain", 5, False), ("f", "favicon", None, False), ("g", "favicon", None, False)], "id string, type string, confidence int, is_root boolean")
    edges = spark.createDataFrame([("1", "h", "f", "X"), ("2", "l", "g", "X")], "id string, source string, target string, type string")
    assert {r.id for r in graph.view(assets, edges)[0].collect()} == set("hrlfg")
    assert {r.id for r in graph.view(assets, edges, min_confidence=50)[0].collect()} == set("hrf")
    assert {r.id for r in graph.view(assets, edges, members=spark.createDataFrame([("l",)], "id string"))[0].collect()} == set("lg")


def test_report_keeps_quiet_about_nothing(spark):
    figures = spark.createDataFrame([("total", "assets", 3)], "section string, name string, n long")
    assert [r.text[:24] for r in report.summary(figures).collect()] == ["3 related assets were id"]
    rows = spark.createDataFrame([("h", "i1", 5), ("h", "i2", 9), ("h", "i0", 9), ("g", "i1", None)], "host string, investigation string, score int")
    assert {(r.host, r.investigation, r.score) for r in report.best_entry(rows).collect()} == {("h", "i0", 9), ("g", "i1", None)}


def test_registered_domains_and_hosts(spark):
    rows = column(spark, "a.b.shop.co.uk", "Shop.com", "x.unknown", "10.0.0.1", "host.lan", "8.8.8.8").select(X.registered_domain(F.col("v")).alias("r"), X.internal_host(F.col("v")).alias("i")).collect()
    assert [(r.r, r.i) for r in rows] == [("shop.co.uk", False), ("shop.com", False), ("x.unknown", False), ("10.0.0.1", True), ("host.lan", True), ("8.8.8.8", False)]


def test_discarded_tables_are_gone(spark):
    df = materialise(spark.range(5), "kept")
    at = df._threadloom_path.removeprefix("file://").removeprefix("file:")
    assert df.count() == 5 and os.path.exists(at) and scratch(spark) in df._threadloom_path
    discard(df)
    assert not os.path.exists(at)


def test_components_of_paths_stars_loops_and_no_edges(spark):
    def roots(edges):
        got = components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert len(got) == len({r.node for r in got})
        return {r.node: r.root for r in got}

    assert roots([]) == {} and roots([(3, 3)]) == {}
    assert roots([(i, i + 1) for i in range(60)]) == dict.fromkeys(range(61), 0)
    assert roots([(9, i) for i in range(1, 9)] + [(9, 1)]) == dict.fromkeys(range(1, 10), 1)
    assert roots([(1, 2), (3, 4), (4, 5)]) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
