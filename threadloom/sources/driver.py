"""The driver tables read as the domain's collections: assets, relationships, run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import edge_id, node_id

#: Asset type and relation of a part by its p_type; others are trackers.
PART_KINDS = {
    "ECONOMY": ("analytics", "SHARES_ANALYTICS"), "SMALL": ("pixel", "SHARES_PIXEL"), "MEDIUM": ("tracking", "SHARES_TRACKING"),
    "PROMO": ("favicon", "SHARES_FAVICON"), "STANDARD": ("certificate", "USES_CERTIFICATE"), "LARGE": ("logo", "SHARES_LOGO"),
}
STATUSES = ("ACTIVE", "INACTIVE", "PARKED", "TAKEDOWN", "ERROR", "UNKNOWN")
START = 1704067200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(of: dict[str, tuple[str, str]], i: int, key: Column) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(key == k, v[i]) if out is None else out.when(key == k, v[i])
    return out.otherwise(("tracking", "SHARES_TRACKING")[i])


def _host(k: Column) -> Column:
    return F.concat(F.lit("supplier-"), k.cast("string"), F.lit(".example"))


def _ip(balance: Column) -> Column:
    return F.concat(F.lit("10.0.0."), F.floor(F.abs(balance) / 500).cast("string"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts from supplier, fingerprint nodes from part, ASNs from nation, hosting from region, IPs from balance buckets."""
    k = F.col("s_suppkey")
    hosts = read(spark, sf_dir, "supplier").select(
        F.lit("domain").alias("type"), _host(k).alias("value"), F.element_at(F.array(*map(F.lit, STATUSES)), (k % 6 + 1).cast("int")).alias("status"),
        (F.floor(F.abs("s_acctbal")) % 101).cast("int").alias("confidence"), (k % 100).cast("int").alias("impersonation_score"), (k % 50 == 1).alias("is_root"),
        F.array(F.concat(F.lit("inv_"), k % 7), F.concat(F.lit("inv_"), k % 5 + 7)).alias("investigation_ids"), F.array(F.concat(F.lit("src"), k % 3)).alias("sources"),
        (START + k % 30 * 86400).alias("first_seen"), (START + k % 30 * 86400 + k % 17 * 3600).alias("last_seen"))

    def plain(name: str, kind: Column, value: Column) -> DataFrame:
        none = {"status": "string", "confidence": "int", "impersonation_score": "int"}
        return read(spark, sf_dir, name).select(
            kind.alias("type"), value.alias("value"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(False).alias("is_root"),
            F.array().cast("array<string>").alias("investigation_ids"), F.array(F.lit(name)).alias("sources"), F.lit(START).cast("long").alias("first_seen"), F.lit(START).cast("long").alias("last_seen"))

    out = hosts
    for one in (
        plain("part", _pick(PART_KINDS, 0, F.col("p_type")), F.concat(F.lit("part-"), F.col("p_partkey"))),
        plain("nation", F.lit("asn"), F.concat(F.lit("AS"), F.col("n_nationkey"))),
        plain("region", F.lit("hosting"), F.concat(F.lit("region-"), F.col("r_regionkey"))),
        plain("supplier", F.lit("ip"), _ip(F.col("s_acctbal"))).distinct(),
    ):
        out = out.unionByName(one)
    return out.withColumn("id", node_id(F.col("type"), F.col("value")))


def host_id(k: Column) -> Column:
    """The asset id of a supplier's key."""
    return node_id(F.lit("domain"), _host(k))


def print_id(relation: Column, k: Column) -> Column:
    """The asset id of a part's key that fingerprint edges of the relation lead to."""
    kind = None
    for of, name in PART_KINDS.values():
        kind = F.when(relation == name, of) if kind is None else kind.when(relation == name, of)
    return node_id(kind, part_value(k))


def part_value(k: Column) -> Column:
    return F.concat(F.lit("part-"), k)


def host_value(k: Column) -> Column:
    return _host(k)


def prints(spark: SparkSession, sf_dir: str, hosts: DataFrame | None = None) -> DataFrame:
    """source, type, target: the fingerprint edges by the keys of supplier and part, in place of ids of 24 digits that no codec shortens.

    With hosts(source, ...; a row each) those of these hosts, and its columns. Lines are dealt out by part once (with
    hosts by host before), which serves their repeats, the join and whatever asks for all edges of a part next.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), "l_partkey")
    lines = lines.repartition("l_partkey").distinct() if hosts is None else lines.repartition("source").distinct().join(hosts, "source")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    more = [] if hosts is None else [c for c in hosts.columns if c != "source"]
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("source", _pick(PART_KINDS, 1, F.col("p_type")).alias("type"), F.col("l_partkey").alias("target"), *more)


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint edges from lineitem (every distinct pair of supplier and part), host to IP and hosting, host to ASN. One row per (source, type, target)."""
    found = prints(spark, sf_dir).select(host_id(F.col("source")).alias("source"), "type", print_id(F.col("type"), F.col("target")).alias("target"), (F.col("source") % 7).alias("inv"))
    return _with_ids(found.unionByName(_infrastructure(spark, sf_dir)))


def infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of relationships() that are no fingerprints."""
    return _with_ids(_infrastructure(spark, sf_dir))


def _with_ids(links: DataFrame) -> DataFrame:
    return links.select(edge_id(F.col("source"), F.col("type"), F.col("target")).alias("id"), "source", "type", "target", F.array(F.concat(F.lit("inv_"), F.col("inv"))).alias("investigation_ids"))


def _infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    host = node_id(F.lit("domain"), _host(F.col("s_suppkey"))).alias("source")
    inv = (F.col("s_suppkey") % 7).alias("inv")
    resolves = supplier.select(host, F.lit("RESOLVES_TO").alias("type"), node_id(F.lit("ip"), _ip(F.col("s_acctbal"))).alias("target"), inv)
    belongs = supplier.select(host, F.lit("BELONGS_TO_ASN").alias("type"), node_id(F.lit("asn"), F.concat(F.lit("AS"), F.col("s_nationkey"))).alias("target"), inv)
    hosted = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(host, F.lit("HOSTED_ON").alias("type"), node_id(F.lit("hosting"), F.concat(F.lit("region-"), F.col("n_regionkey"))).alias("target"), inv)
    return resolves.unionByName(belongs).unionByName(hosted)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts from supplier as page profiles: key, host, type, value, title (of a part), html (64-bit hash), screenshot, logo. A few are named below another host."""
    k = F.col("s_suppkey")
    value = F.when(k % 10 == 3, F.concat(F.lit("www."), _host(k - 2))).otherwise(_host(k))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("s_suppkey"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    html = (k % 9 * F.lit(123456789123456789)).bitwiseXOR((k % 16).cast("long"))
    none = F.lit(None).cast("long")
    return read(spark, sf_dir, "supplier").join(part, "s_suppkey", "left").select(
        k.alias("key"), node_id(F.lit("domain"), _host(k)).alias("host"), F.lit("domain").alias("type"), value.alias("value"), "title", html.alias("html"), F.when(k % 3 == 0, html).otherwise(none).alias("screenshot"), none.alias("logo"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as provider runs: provider, username, moment (epoch seconds), day, ok, latency, detail."""
    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", F.col("event_type").alias("provider"), F.concat(F.lit("user"), F.col("user_id")).alias("username"), F.unix_timestamp(ts).alias("moment"),
        F.date_format(ts, "yyyy-MM-dd").alias("day"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("int").alias("detail"))
