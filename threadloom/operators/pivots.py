"""Provider pivots: what is asked for a seed, of whom, and how answers join the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ioc
from threadloom.functions import text as X
from threadloom.operators.suffixes import without_known

# Asset types of the node that answers to a pivot attach to.
NODE_TYPES = {"cert_sha256": ("certificate",), "cert_sha1": ("certificate",), "favicon_mmh3": ("favicon",), "favicon_sha256": ("favicon",), "tracking_id": ("analytics", "pixel", "tracking")}
#: Of a pivot's answer, and of a seed's tracking ids.
MOST_ENTITIES, MOST_TRACKERS = 150, 5


def asked(seeds: DataFrame) -> DataFrame:
    """seed, kind, value, node_value of seeds(seed, cert_sha256, cert_sha1, favicon_mmh3, favicon_sha256, title, tracking_ids): each value that is there, the first five tracking ids.

    node_value is the value of the asset that answers attach to; null for a title.
    """
    pair = lambda kind, value, node: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), node.cast("string").alias("node_value"))
    c = F.col
    one = [pair("cert_sha256", c("cert_sha256"), c("cert_sha256")), pair("cert_sha1", c("cert_sha1"), c("cert_sha256")), pair("favicon_mmh3", c("favicon_mmh3"), c("favicon_mmh3")), pair("favicon_sha256", c("favicon_sha256"), c("favicon_mmh3")), pair("title", c("title"), F.lit(None))]
    trackers = F.transform(F.slice(F.coalesce("tracking_ids", F.array().cast("array<string>")), 1, MOST_TRACKERS), lambda t: pair("tracking_id", t, t))
    return seeds.select("seed", F.explode(F.concat(F.array(*one), trackers)).alias("p")).select("seed", "p.*").filter("value <> ''")


def eligible(providers: DataFrame, kind: str, names: list[str] | None = None, exclude: list[str] | None = None, category: str | None = None, credits: bool = True) -> DataFrame:
    """providers(name, category, types, enabled, credit, priority) that are enabled and take kind, with their place by priority and name.

    names restricts and exclude removes; without credits those that cost any are left out. A table of providers is small; the place is a window over it.
    """
    from pyspark.sql import Window as W

    out = providers.filter(F.col("enabled") & F.array_contains("types", kind))
    for wanted, condition in ((names, F.col("name").isin(names or [])), (exclude, ~F.col("name").isin(exclude or [])), (category, F.col("category") == category)):
        out = out.filter(condition) if wanted else out
    out = out if credits else out.filter(~F.col("credit"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("priority", "name")))


def credits_allowed(policy: str, found: Column, least: int, unreachable: Column | None = None) -> Column:
    """Whether sources that cost may be asked: always, never, or when needed, which is with fewer than least found or an unreachable site."""
    if policy not in ("always", "never", "when_needed"):
        raise ValueError(f"no credit policy {policy!r}")
    needed = found < least
    return F.lit(policy == "always") if policy != "when_needed" else needed if unreachable is None else needed | F.coalesce(unreachable, F.lit(False))


def fan_out(pivots: DataFrame, providers: DataFrame, names: list[str] | None = None, credits: bool = True) -> DataFrame:
    """pivots as asked() gives them, each with every provider that is enabled and takes its kind: provider."""
    able = providers.filter("enabled")
    able = able.filter(F.col("name").isin(names)) if names else able
    able = able if credits else able.filter(~F.col("credit"))
    return pivots.join(able.select(F.col("name").alias("provider"), F.explode(F.array_distinct("types")).alias("kind")), "kind").select("seed", "kind", "value", "node_value", "provider")


def attached(pivots: DataFrame, answers: DataFrame, assets: DataFrame, suffixes: DataFrame) -> DataFrame:
    """source, relation, target, type, value, provider, pivot: the edges that answers(kind, value, provider, related) make for pivots(seed, seed_value, kind, value, node_value, provider).

    related is an array of structs (type, value, relation); its first 150 count. A domain that is no domain name or
    known infrastructure, an empty value and the seed itself are dropped. The entity is the source, its target the
    node of the shared fingerprint among assets(id, type, value), the least id of several, or else the seed.
    An edge that several answers make stays once, with the first provider and pivot by name.
    """
    kinds = None
    for kind, types in NODE_TYPES.items():
        kinds = F.when(F.col("kind") == kind, F.array(*map(F.lit, types))) if kinds is None else kinds.when(F.col("kind") == kind, F.array(*map(F.lit, types)))
    wanted = pivots.select("kind", "node_value").distinct().filter("node_value IS NOT NULL").select("kind", "node_value", F.explode(kinds).alias("t"))
    nodes = wanted.join(assets.select("id", F.col("type").alias("t"), F.col("value").alias("node_value")), ["t", "node_value"]).groupBy("kind", "node_value").agg(F.min("id").alias("node"))
    # seeds with one target and answer make the same edges, but that an entity equal to the only seed is dropped
    placed = pivots.join(nodes, ["kind", "node_value"], "left").withColumn("target", F.coalesce("node", "seed"))
    seeds = placed.groupBy("target", "kind", "value", "provider").agg(F.min("seed_value").alias("low"), F.max("seed_value").alias("high"), F.count_if(F.col("seed_value").isNull()).alias("unnamed"))
    own = F.when((F.col("unnamed") == 0) & (F.col("low") == F.col("high")), F.col("low"))
    met = seeds.join(answers, ["kind", "value", "provider"]).select("target", F.col("kind").alias("pivot"), "provider", own.alias("own"), F.explode(F.slice("related", 1, MOST_ENTITIES)).alias("r"))
    each = met.select("target", "pivot", "provider", "own", "r.type", F.trim("r.value").alias("value"), "r.relation").filter("value <> '' AND (own IS NULL OR value <> own)").drop("own")
    edges = each.groupBy("target", "type", "value", "relation").agg(F.min(F.struct("provider", "pivot")).alias("f"))
    domains = edges.filter("type = 'domain'")
    fine = domains.join(domains.select("value").distinct().filter(ioc.parse_ioc(F.col("value"))["type"] == "domain"), "value", "left_semi").select(edges.columns)
    kept = without_known(fine, suffixes).unionByName(edges.filter("type <> 'domain'"))
    return kept.select(X.node_id(F.col("type"), F.col("value")).alias("source"), "relation", "target", "type", "value", "f.provider", "f.pivot")


def infrastructure(resolved: DataFrame, routes: DataFrame, most: int = 3) -> DataFrame:
    """host, ips, asns, hosting, country from resolved(host, a, aaaa; arrays) and routes(ip, asn, hosting, country).

    ips are the distinct addresses, those of a first; routes are looked up for the first most of a. asns and hosting are
    sorted and distinct, country that of the first of those addresses that has one.
    """
    none = F.array().cast("array<string>")
    ips = F.array_distinct(F.concat(F.coalesce("a", none), F.coalesce("aaaa", none)))
    each = resolved.select("host", F.posexplode(F.slice(F.coalesce("a", none), 1, most)).alias("pos", "ip")).join(routes, "ip")
    facts = each.groupBy("host").agg(F.array_sort(F.collect_set("asn")).alias("asns"), F.array_sort(F.collect_set("hosting")).alias("hosting"), F.min_by("country", F.when(F.col("country").isNotNull(), F.col("pos"))).alias("country"))
    return resolved.select("host", ips.alias("ips")).join(facts, "host", "left").select("host", "ips", F.coalesce("asns", none).alias("asns"), F.coalesce("hosting", none).alias("hosting"), "country")
