import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.plans import queries
from threadloom.config import Scoring
from threadloom.functions import ioc, pages, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    lit = F.lit
    r = one(spark,
        text.normalize_title(lit("  Sign-In | My_BANK  ")).alias("title"), text.string_similarity(lit("kitten"), lit("sitting")).alias("near"),
        text.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b"), lit("c"))).alias("j"), text.jaccard(F.array().cast("array<string>"), F.array(lit("b"))).alias("j0"),
        text.shingles(F.array(*map(lit, "abcd")), 3).alias("s"), text.shingles(F.array(*map(lit, "ab")), 3).alias("s2"),
        text.hash_similarity(lit("ffff000000000000"), lit("fffe000000000000")).alias("h"), text.hash_similarity(lit("zz"), lit("ff")).alias("h0"),
        text.refang(lit(" <hxxps://evil[.]test/x> ")).alias("r"), text.csv_cell(lit("=1+1")).alias("c"), text.csv_cell(lit(None).cast("string")).alias("c0"),
        text.mask_secret(lit("abcdefghijkl")).alias("m"), text.slug(lit("a b/c")).alias("slug"), text.clean_tags(F.array(lit(" B "), lit("a"), lit("b"), lit(""))).alias("tags"),
        text.url_host(lit("http://[2001:DB8::1]:80/x")).alias("host"), text.last_n(F.array(lit(1), lit(2)), 3).alias("last"))
    assert (r.title, round(r.near, 4), round(r.j, 4), r.j0) == ("sign in my bank", 0.5714, 0.3333, 0)
    assert (r.s, r.s2, r.h, r.h0) == (["a b c", "b c d"], ["a b"], 1 - 1 / 64, 0)
    assert (r.r, r.c, r.c0, r.m, r.slug, r.tags, r.host, r["last"]) == ("https://evil.test/x", "'=1+1", "", "abcd****ijkl", "a-b-c", ["a", "b"], "2001:db8::1", [1, 2])


@pytest.mark.parametrize("raw,kind,value", [
    ("Example.TEST.", "domain", "example.test"), ("*.a.example.test", "domain", "a.example.test"), ("HTTP://Example.test:80", "url", "http://example.test/"),
    ("https://example.test/a?b#c", "url", "https://example.test/a?b"), ("example.test/login", "url", "http://example.test/login"), ("192.0.2.1", "ip", "192.0.2.1"),
    ("2001:DB8::1", "ip", "2001:db8::1"), ("AB:" * 19 + "AB", "certificate", "ab" * 20), ("ftp://example.test", None, None), ("no", None, None), ("", None, None), ("-a.test", None, None),
])
def test_indicators(raw, kind, value):
    assert ioc.parse(raw)[:2] == (kind, value)


def test_hashes(spark):
    assert ioc.murmur3(b"") == 0 and ioc.murmur3(b"hello") == 613153351 and ioc.murmur3(b"foo") == -156908512
    r = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "f array<string>").select(ioc.simhash("f").alias("h")).collect()
    assert r[0].h == ioc.simhash_of(["c", "b", "a"]) and len(r[0].h) == 16 and r[1].h is r[2].h is None


def test_page_features(spark):
    html = """<html><head><title> Log in </title><link rel="shortcut icon" href="/f.ico"><script>gtag('config','G-ABCDEF1234'); fbq('init', '12345678901')</script></head>
      <body class="b a"><img src="/logo.png"><form action="https://other.test/x" method="POST"><input name="user"><input type="password" name="p"><input type="hidden" name="h"></form>mail me@example.test</body></html>"""
    d = spark.createDataFrame([(html,), ("",), (None,), ("<b>G-ABCDEF1234",)], "html string")
    r = d.select(pages.title(F.col("html")).alias("t"), pages.trackers(F.col("html")).alias("ids"), pages.emails(F.col("html")).alias("m"), pages.visible_text(F.col("html")).alias("v"), ioc.page_structure("html").alias("p")).collect()
    assert r[0].t == "Log in" and [(x.family, x.id) for x in r[0].ids] == [("ga4", "G-ABCDEF1234"), ("meta_pixel", "12345678901")]
    assert r[0].m == ["me@example.test"] and r[0].v == "Log in mail me@example.test"
    assert r[0].p.forms[0].inputs == ["text:user", "password:p"] and r[0].p.icons == ["/f.ico"] and r[0].p.logos == ["/logo.png"]
    assert r[1].ids == [] and r[2].ids == [] and r[3].ids == []


@pytest.mark.parametrize("said,code,words,status,confidence", [
    ("This domain has been seized by the FBI", 200, 9, "TAKEDOWN", 99), ("Buy this domain now", 200, 4, "PARKED", 80), ("", 404, 0, "INACTIVE", 75),
    ("welcome", 200, 80, "ACTIVE", 70), ("hello", 200, 1, "ACTIVE", 55), ("", 503, 0, "ERROR", 60), ("", 403, 0, "ACTIVE", 45), (None, None, 0, "ERROR", 40),
])
def test_verdict(spark, said, code, words, status, confidence):
    d = spark.createDataFrame([(said, code, words)], "said string, code int, words int")
    r = pages.verdict(d, F.col("said"), F.col("code"), F.col("words"), F.lit(False)).first()
    assert (r.status, r.confidence) == (status, confidence)


@pytest.mark.parametrize("code,html,error,dns,ns,registry,status,confidence", [
    (200, "x", None, True, [], ["Client Hold"], "TAKEDOWN", 90), (None, None, None, False, [], [], "INACTIVE", 85),
    (None, None, "read failed", True, ["ns1.sedoparking.com"], [], "PARKED", 70), (None, None, "Connection refused", True, [], [], "INACTIVE", 70),
    (None, None, "bad chunk", None, None, None, "ERROR", 60), (200, "/cgi-sys/suspendedpage.cgi", None, True, [], [], "TAKEDOWN", 85),
    (200, "<img src=//hugedomains.com>", None, True, [], [], "PARKED", 70), (200, "x", None, True, ["a.bodis.com"], [], "PARKED", 70),
    (403, "account-suspended", None, True, [], [], "TAKEDOWN", 95), (500, "", None, True, [], [], "ERROR", 60), (200, "<p>hello", None, None, None, None, "ACTIVE", 55),
])
def test_verdict_beyond_the_text(spark, code, html, error, dns, ns, registry, status, confidence):
    d = spark.createDataFrame([(code, html, error, dns, ns, registry)], "code int, html string, error string, dns boolean, ns array<string>, registry array<string>")
    r = pages.verdict(d, F.lit("hello"), F.col("code"), F.lit(1), F.lit(False), *map(F.col, ("html", "error", "dns", "ns", "registry"))).first()
    assert (r.status, r.confidence) == (status, confidence)


def test_verdict_query_reads_the_document(spark, tmp_path):
    said = [(4, "This domain has been seized"), (9, "Buy this domain now"), (14, "plain"), (5, None)]
    spark.createDataFrame(said, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.status for r in queries.content_verdict(spark, str(tmp_path)).collect()} == {4: "TAKEDOWN", 9: "PARKED", 14: "ACTIVE", 5: "TAKEDOWN"}


def test_verdict_query_reads_odd_texts_as_its_sql(spark, tmp_path):
    """Letters beyond ASCII beside a word, line ends within a pattern, and letters that change their length."""
    said = ["la sedoñiear", "ésedo sedoé", "sedo_ _sedo", "sedo1", "ñsedo.", "404\r not found", "404\u2028not found", "404\u0085not found", "404\nnot found", "é404é not found", "not found 404",
        "SİTE NOT FOUND", "İNDEX OF /", "INDEX OF /", "ñdomain expired", "domain expiredñ", "clientholdß", "\u212aclienthold", "", " ", None, "a " * 40, "404" + "x" * 41 + "not found", "404" + "\U0001f600" * 40 + "not found", "dan.com", "danxcom"]
    rows = [(5 * i + 4, s) for i, s in enumerate(said)] + [(5 * i + 8, s) for i, s in enumerate(said)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT doc_id, status, confidence FROM ({queries.ORACLE_SQL['content_verdict']})").fetchall()
    assert sorted(tuple(r) for r in queries.content_verdict(spark, str(tmp_path)).collect()) == sorted(want)


def test_scoring_is_validated():
    with pytest.raises(ValueError):
        Scoring({"colour": 1.0})
    with pytest.raises(ValueError):
        Scoring({"ip": 101.0})
    with pytest.raises(ValueError):
        Scoring(levels=(("a", 10), ("b", 20)))
    assert Scoring().merged(ip=20.0).weights["ip"] == 20
