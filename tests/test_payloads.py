import json

from pyspark.sql import functions as F

from threadloom.functions import pages as P
from threadloom.operators import profiles
from threadloom.sources import payloads


def answers(spark, *values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, payload string").coalesce(1)


def pairs(related):
    return [(r.type, r.value, r.relation, r.reverse) for r in related]


def test_registry_walks_contacts_within_contacts(spark):
    card = lambda *fields: ["vcard", [[f, {}, "text", v] for f, v in fields]]
    abuse = {"roles": ["abuse"], "vcardArray": card(("email", "abuse@r.example"))}
    registrar = {"roles": ["registrar"], "vcardArray": card(("fn", "R Inc")), "publicIds": [{"type": "IANA Registrar ID", "identifier": "7"}], "entities": [abuse]}
    owner = {"roles": ["registrant"], "vcardArray": card(("fn", "A. Person"), ("org", ["Acme", "", "Ltd"]))}
    answer = {"handle": "H", "status": ["ok"], "events": [{"eventAction": "registration", "eventDate": "2020"}], "nameservers": [{"ldhName": "NS2.X.example."}, {"ldhName": "ns1.x.example"}], "secureDNS": {"delegationSigned": True}, "entities": [registrar, owner]}
    good, net, null, bad = payloads.registry(answers(spark, answer, {"name": "NET", "cidr0_cidrs": [{"v4prefix": "192.0.2.0", "length": 24}]}, None, "no json")).orderBy("i").collect()
    assert (good.handle, good.created, good.expires, good.signed, good.registrar, good.iana_id, good.registrant, good.abuse_email) == ("H", "2020", None, True, "R Inc", "7", "Acme Ltd", "abuse@r.example")
    assert good.nameservers == ["ns1.x.example", "ns2.x.example"] and pairs(good.related)[0] == ("nameserver", "ns1.x.example", "USES_NAMESERVER", False)
    assert net.network == "NET" and net.cidr == ["192.0.2.0/24"] and net.related == [] and null.related == bad.related == [] and null.registrar is None


def test_reputation_answers(spark):
    a, none = payloads.abuse_reports(answers(spark, {"data": {"abuseConfidenceScore": 90, "isTor": False, "hostnames": ["A.example", "bad name"]}}, {})).orderBy("i").collect()
    assert (a.score, a.tor, pairs(a.related)) == (90, False, [("domain", "a.example", "RESOLVES_TO", True)]) and none.score is None and none.related == []
    assert [r.seen for r in payloads.noise(answers(spark, {"noise": False, "riot": True}, {"noise": False}, None)).orderBy("i").collect()] == [True, False, False]
    records = [{"type": "A", "value": "192.0.2.1"}, {"type": "A", "value": "999.0.2.1"}, {"type": "AAAA", "value": "2001:db8::1"}, {"type": "NS", "value": "NS1.x.example."}, {"type": "TXT", "value": "x"}]
    v, none = payloads.scanner_verdicts(answers(spark, {"data": {"attributes": {"last_analysis_stats": {"malicious": 3}, "last_dns_records": records, "last_https_certificate": {"thumbprint_sha256": "AB", "issuer": {"O": "CA"}}}}}, None)).orderBy("i").collect()
    assert (v.malicious, v.harmless, v.issuer, v.certificate) == (3, 0, "CA", "ab") and none.malicious is None and none.related == []
    assert [x[:2] for x in pairs(v.related)] == [("ip", "192.0.2.1"), ("ip", "2001:db8::1"), ("nameserver", "ns1.x.example"), ("certificate", "ab")]


def test_hosts_hits_and_certificate_pages(spark):
    host = {"services": [{"port": 443, "service_name": "HTTP", "software": [{"product": "nginx"}, {}], "tls": {"certificates": {"leaf_fp_sha_256": "CD"}}}, {"port": 22, "protocol": "SSH", "cert": {"fingerprint_sha256": "ef"}}], "autonomous_system": {"asn": 64500}, "dns": {"names": ["b.example", "A.example", "?"]}}
    for wrapped in ({"result": host}, {"result": {"resource": host}}):
        (r,) = payloads.host_services(answers(spark, wrapped)).collect()
        assert [(s.port, s.protocol, s.certificate) for s in r.services] == [(443, "HTTP", "cd"), (22, "SSH", "ef")] and r.services[0].software == ["nginx"]
        assert r.asn == "AS64500" and r.names == ["a.example", "b.example"] and len(r.related) == 4
    (r,) = payloads.search_hits(answers(spark, {"size": 2, "results": [["https://W.example:8443", "192.0.2.9", "T"], ["w.example", "192.0.2.9", ""]]}), ["host", "ip", "title"], "SHARES_FAVICON").collect()
    assert (r.total, r.ips, r.titles, [x.value for x in r.related]) == (2, ["192.0.2.9"], ["T"], ["w.example", "192.0.2.9"])
    (r,) = payloads.certificate_page(answers(spark, '<a href="?id=12">x</a>DNS:*.B.example<br>DNS:a.example').withColumnRenamed("payload", "page")).collect()
    assert (r.found, r.log_id, r.names) == (True, "12", ["a.example", "b.example"])


def test_cookies_and_bodies(spark):
    lines = spark.createDataFrame([(["sid=\"a=b\"; Path=/; HttpOnly; SameSite=Lax", "x=1; Secure; Domain=d.example", "=z"],), (None,)], "h array<string>").select(payloads.cookies(F.col("h")).alias("c")).collect()
    assert [tuple(c) for c in lines[0].c] == [("sid", "a=b", None, "/", False, True, "Lax"), ("x", "1", "d.example", None, True, False, None)] and lines[1].c is None
    rows = spark.createDataFrame([("é".encode("latin-1"), None), ("д".encode("cp1251"), 'text/html; charset="windows-1251"'), (b'<meta charset="latin-1">\xe9', ""), ("é".encode(), "text/html; charset=none"), (None, None)], "b binary, t string").coalesce(1)
    assert [r.x for r in rows.select(payloads.body_text("b", "t").alias("x")).collect()] == ["é", "д", '<meta charset="latin-1">é', "é", None]


def test_page_entries_hosts_and_hints(spark):
    html = """<html lang='de'><meta name="Description" content="one"><meta content='two' property=og:title><meta name=description content="three"><meta name=other content=x>
    <script src="//cdn.other.com/a.js"></script><link href=/s.css><a href="mailto:x@y.example">m</a><img src='https://img.site.com/i.png'><meta http-equiv="refresh" content="3; url=/next">
    <script>window.location.href = "https://b.example"; location.replace('/a')</script>"""
    df = spark.createDataFrame([(html, "https://www.site.com/p"), ("", "https://www.site.com/"), (None, None)], "h string, u string").coalesce(1)
    r, empty, null = df.select(P.language(F.col("h")).alias("l"), P.metadata(F.col("h")).alias("m"), P.resource_hosts(F.col("h"), F.col("u")).alias("r"), P.redirect_hints(F.col("h")).alias("x")).collect()
    assert r.l == "de" and r.m == {"description": "three", "og:title": "two", "refresh": "3; url=/next"}
    assert r.r.scripts == ["cdn.other.com"] and r.r.resources == ["cdn.other.com", "img.site.com", "www.site.com"] and r.r.external == ["cdn.other.com"]
    assert r.x.refresh == "/next" and r.x.scripted == ["/a", "https://b.example"]
    assert empty.l is None and empty.m == {} and empty.r.resources == [] and null.m == {} and null.r.scripts is None


def test_look_alikes_lose_no_match(spark):
    import random

    r = random.Random(3)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    asked = [r.getrandbits(64) for _ in range(5)]
    stored = [(i, asked[i % 5] ^ sum(1 << b for b in r.sample(range(64), i % 14))) for i in range(300)]
    df = spark.createDataFrame([(i, signed(h), None) for i, h in stored] + [(999, None, None)], "host int, phash long, dhash long")
    uploads = spark.createDataFrame([(i, signed(h), signed(h)) for i, h in enumerate(asked)], "upload int, phash long, dhash long")
    for least in (0.82, 0.9, 1.0):
        got = {(x.upload, x.host): x.similarity for x in profiles.look_alikes(df, uploads, least).collect()}
        want = {(u, i): 1 - (g ^ h).bit_count() / 64 for u, g in enumerate(asked) for i, h in stored}
        assert got == {k: v for k, v in want.items() if v >= least}


def test_certificates_match_by_either_hash(spark):
    stored = spark.createDataFrame([(1, "domain", "a", "k"), (2, "ip", "b", "k"), (3, "domain", None, None), (4, "domain", "a", "z"), (5, "url", "a", "k"), (6, None, "a", "k")], "host int, type string, certificate string, key string")
    uploads = spark.createDataFrame([(9, "a", "k"), (8, None, None)], "upload int, certificate string, key string")
    assert {tuple(r) for r in profiles.certificate_matches(stored, uploads).collect()} == {(9, 1), (9, 2), (9, 4)}


def test_certificate_matches_are_counted_without_pairs(spark):
    """A certificate that 20,000 hosts and as many uploads share would be 400 million pairs."""
    stored = spark.createDataFrame([(1, "domain", "a", "k"), (2, "ip", "b", "k"), (3, "domain", None, None), (4, "domain", "a", "z"), (5, "url", "a", "k"), (6, None, "a", "k"), (7, "ip", "c", None)], "host int, type string, certificate string, key string")
    uploads = spark.createDataFrame([(9, "a", "k"), (8, None, None), (10, None, "k"), (11, "c", None), (12, "q", "q")], "upload int, certificate string, key string")
    pairs = profiles.certificate_matches(stored, uploads).groupBy("upload").count()
    counts = profiles.certificate_match_counts(stored, uploads)
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in pairs.collect()} == {(9, 3), (10, 2), (11, 1)}
    many = spark.range(20_000).selectExpr("id AS host", "'ip' AS type", "'a' AS certificate", "CAST(id % 7 AS STRING) AS key")
    found = profiles.certificate_match_counts(many, many.withColumnRenamed("host", "upload"))
    assert found.agg(F.count("hosts"), F.min("hosts"), F.max("hosts")).first() == (20_000, 20_000, 20_000)
