"""Evidence-weighted correlation of hosts with seeds, exact and similarity pivots, clusters."""

from __future__ import annotations

from itertools import combinations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import HOST_TYPES, NOISE_FACTOR, RELATION_FEATURES, Scoring

# Autonomous systems of content networks, and parts of the names of common name servers.
CDN_ASNS = (
    "AS13335", "AS20940", "AS16625", "AS54113", "AS15169", "AS8075", "AS16509", "AS14618", "AS209242", "AS396982", "AS8068", "AS32934", "AS19551", "AS60068",
)
SHARED_NAMESERVERS = (
    "cloudflare.com", "awsdns", "domaincontrol.com", "azure-dns", "googledomains.com", "registrar-servers.com", "nsone.net", "dnsmadeeasy.com", "ultradns",
    "akam.net", "dynect.net", "hostinger", "name-services.com", "dns.google",
)
INFRA = {"RESOLVES_TO": "ip", "BELONGS_TO_ASN": "asn", "HOSTED_ON": "hosting", "USES_NAMESERVER": "nameserver"}


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain(*pairs.items()))), key)


def host_features(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """host, feature, node: what each host carries, from its own edges and, for ASN and hosting, those of its IPs. Tracker containers (GTM-) are feature gtm."""
    hosts = assets.filter(F.col("type").isin(*HOST_TYPES)).select(F.col("id").alias("host"))
    named = edges.join(hosts, edges.source == hosts.host).select("host", F.col("type").alias("relation"), F.col("target").alias("node"))
    direct = named.withColumn("feature", _lookup(RELATION_FEATURES | INFRA, F.col("relation"))).filter(F.col("feature").isNotNull())
    beyond = edges.filter(F.col("type").isin("BELONGS_TO_ASN", "HOSTED_ON")).select(F.col("source").alias("ip"), F.col("type").alias("relation"), F.col("target").alias("node"))
    hop = direct.filter("feature = 'ip'").select("host", F.col("node").alias("ip")).join(beyond, "ip")
    hop = hop.select("host", "relation", "node", _lookup(INFRA, F.col("relation")).alias("feature"))
    containers = assets.filter("type = 'tracking' AND value LIKE 'GTM-%'").select(F.col("id").alias("node"), F.lit(True).alias("gtm"))
    out = direct.unionByName(hop).join(containers, "node", "left")
    return out.select("host", F.when(F.col("gtm") & (F.col("feature") == "tracking"), "gtm").otherwise(F.col("feature")).alias("feature"), "node").distinct()


def noisy_nodes(edges: DataFrame, limit: int) -> DataFrame:
    """node, n: targets with more than limit edges."""
    return edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def evidence(features: DataFrame, seeds: DataFrame, noisy: DataFrame, scoring: Scoring, labels: DataFrame | None = None) -> DataFrame:
    """host, feature, shared, weight: features whose nodes a host shares with any of seeds(host), which are left out themselves.

    A fingerprint or IP is damped if all shared nodes are noisy. With labels(node, label), the names of nodes,
    IP and hosting are damped too if any ASN of the seeds is a CDN's, ASN if any shared one is, and
    nameserver if all shared ones are a common provider's. Weights are rounded to one decimal, half to even.
    """
    wanted = features.join(seeds, "host", "left_semi").select("feature", "node").distinct()
    met = features.join(seeds, "host", "left_anti").join(wanted, ["feature", "node"]).join(noisy.select("node", F.lit(True).alias("noisy")), "node", "left")
    each = F.coalesce("noisy", F.lit(False)) & ~F.col("feature").isin("asn", "hosting", "nameserver")
    damped, cdn = F.bool_and(each), F.lit(False)
    if labels is not None:
        met = met.join(labels, "node", "left")
        name = F.coalesce("label", F.lit(""))
        content = F.bool_or((F.col("feature") == "asn") & F.upper(name).isin(*CDN_ASNS))
        common = F.bool_and((F.col("feature") == "nameserver") & F.lower(name).rlike("|".join(s.replace(".", r"\.") for s in SHARED_NAMESERVERS)))
        damped = damped | content | common
        own = wanted.filter("feature = 'asn'").join(labels, "node").agg(F.coalesce(F.bool_or(F.upper("label").isin(*CDN_ASNS)), F.lit(False)).alias("cdn"))
        cdn = F.col("cdn") & F.col("feature").isin("ip", "hosting")
    grouped = met.groupBy("host", "feature").agg(F.count(F.lit(1)).alias("shared"), damped.alias("damped"))
    if labels is not None:
        grouped = grouped.join(F.broadcast(own))  # one row
    weight = _lookup(scoring.weights, F.col("feature"))
    return grouped.select("host", "feature", "shared", F.bround(F.when(F.col("damped") | cdn, weight * NOISE_FACTOR).otherwise(weight), 1).alias("weight")).filter("weight > 0")


def level(score: Column, scoring: Scoring) -> Column:
    out = F.when(score >= scoring.levels[0][1], scoring.levels[0][0])
    for name, least in scoring.levels[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Informational")


def correlate(assets: DataFrame, edges: DataFrame, seeds: DataFrame, scoring: Scoring | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """host, score, level, features: every host that shares a feature with seeds(host), and the seeds at 100.

    profiles, as profile_evidence() takes them, add what hosts look like; a certificate or logo counts once,
    first as a shared node. The score is the sum of weights, 100 at most, rounded half to even; features
    lists feature=weight by falling weight and name.
    """
    scoring = scoring or Scoring()
    labels = assets.filter(F.col("type").isin("asn", "nameserver")).select(F.col("id").alias("node"), F.col("value").alias("label"))
    found = evidence(host_features(assets, edges), seeds, noisy_nodes(edges, scoring.noisy_limit), scoring, labels).select("host", "feature", "weight", F.lit(0).alias("rank"))
    if profiles is not None:
        from threadloom.operators.profiles import profile_evidence

        found = found.unionByName(profile_evidence(profiles, edges, seeds, scoring).withColumn("rank", F.lit(1)))
        found = found.groupBy("host", "feature").agg(F.min_by("weight", "rank").alias("weight"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "feature")))
    scored = found.groupBy("host").agg(F.bround(F.least(F.sum("weight"), F.lit(100.0))).cast("int").alias("score"), ordered.alias("m"))
    listed = F.array_join(F.transform("m", lambda m: F.concat_ws("=", m["feature"], (-m["w"]).cast("decimal(6,2)").cast("string"))), ",")
    out = scored.select("host", "score", listed.alias("features")).unionByName(seeds.select("host", F.lit(100).alias("score"), F.lit("").alias("features")))
    return out.withColumn("level", level(F.col("score"), scoring))


def exact_pivot(prints: DataFrame, seeds: DataFrame, most: int = 200) -> DataFrame:
    """seed, host, field, value: other hosts with a value of seeds(host) in prints(host, field, value).

    Values that more than most hosts share tell nothing and are left out before the join.
    """
    telling = prints.groupBy("field", "value").agg(F.count_distinct("host").alias("n")).filter(F.col("n").between(2, most)).select("field", "value")
    mine = prints.join(seeds, "host", "left_semi").select(F.col("host").alias("seed"), "field", "value").join(telling, ["field", "value"])
    return mine.join(prints, ["field", "value"]).filter("seed <> host").select("seed", "host", "field", "value").distinct()


def hamming_links(hashes: DataFrame, distance: int) -> DataFrame:
    """a, b, bits: links of hashes(id, h) with at most distance differing bits of 64, a < b; every link between different hashes is there.

    Equal hashes are settled first: each id is linked to the least of its hash, and that one stands for all.
    Of distance + 1 bands of bits, two different hashes within distance agree in one at least, so an equi-join
    on bands loses none; a pair is made at its first common band. distance is 7 at most, so that a band has
    eight bits.
    """
    if not 0 <= distance <= 7:
        raise ValueError("distance lies between 0 and 7")
    bands = distance + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    band = lambda h, i: F.shiftrightunsigned(F.shiftleft(h, 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i])
    least = hashes.groupBy("h").agg(F.min("id").alias("id"))
    alike = hashes.join(least.withColumnRenamed("id", "a"), "h").filter("a <> id").select("a", F.col("id").alias("b"), F.lit(0).alias("bits"))
    each = least.select("id", "h", F.posexplode(F.array(*(band(F.col("h"), i) for i in range(bands)))).alias("band", "part"))
    x, y = each.alias("x"), each.alias("y")
    earlier = F.lit(False)
    for i in range(bands - 1):
        earlier = earlier | ((F.col("x.band") > i) & (band(F.col("x.h"), i) == band(F.col("y.h"), i)))
    far = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h")))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") < F.col("y.id"))
    near = x.join(y, same & (far <= distance) & ~earlier)
    return near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), far.cast("int").alias("bits")).unionByName(alike)


def probe_plan(distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of blocks of a 64-bit hash such that hashes within distance are within radius in one block at least.

    If two hashes lay beyond the radius in every block, they would differ in the sum of (radius + 1) bits; the
    radii make that distance + 1. Four blocks of 16 bits ask for 68 values of 65,536 at most up to a distance of 7; up
    to 11 three blocks of 21 or 22 bits ask for more values, of which far fewer are met; beyond, four again.
    """
    if not 0 <= distance < 32:
        raise ValueError("distance lies between 0 and 31")
    blocks = min(3 if 7 < distance <= 11 else 4, distance + 1)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spare = distance + 1 - blocks  # to be shared out as radii
    return [(edges[i], edges[i + 1] - edges[i], spare // blocks + (i < spare % blocks)) for i in range(blocks)]


def hamming_search(stored: DataFrame, asked: DataFrame, distance: int) -> DataFrame:
    """h, g, bits: each distinct hash h of stored(h) with each g of asked(g) from which it differs in distance of 64 bits or fewer; none is lost.

    Only the asked side is multiplied, by the values around each of its blocks; a stored hash has a row per block.
    Equal hashes are one on either side. Nulls are like nothing.
    """
    plan = probe_plan(distance)
    block = lambda x, lo, n: F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else x
    have = stored.filter("h IS NOT NULL").select("h").distinct()
    have = have.select("h", F.posexplode(F.array(*(block(F.col("h"), lo, n) for lo, n, _ in plan))).alias("i", "part"))
    wanted = asked.filter("g IS NOT NULL").select("g").distinct()

    def around(lo: int, n: int, radius: int) -> Column:
        masks = [sum(1 << b for b in on) for k in range(radius + 1) for on in combinations(range(n), k)]
        return F.transform(F.lit(masks).cast("array<long>"), lambda m: block(F.col("g"), lo, n).bitwiseXOR(m))

    probes = wanted.select("g", F.posexplode(F.array(*(around(*b) for b in plan))).alias("i", "parts")).select("g", "i", F.explode("parts").alias("part"))
    far = F.bit_count(F.col("h").bitwiseXOR(F.col("g")))
    return have.join(probes, ["i", "part"]).filter(far <= distance).select("h", "g", far.cast("int").alias("bits")).distinct()


def sign_hash(vector: Column) -> Column:
    """64 bits from the signs of a vector of 64 numbers, the first the highest."""
    return F.aggregate(F.transform(vector, lambda v: F.when(v > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))


def severity(active_high: Column, active_mid: Column, any_high: Column, any_low: Column, active: Column, members: Column) -> Column:
    return F.when(active_high > 0, "critical").when((active_mid > 0) | (any_high > 0), "high").when((any_low > 0) | (active >= 3), "medium").when(members > 0, "low").otherwise("info")


def summarise(operations: DataFrame, assets: DataFrame) -> DataFrame:
    """root, members, active, confidence (rounded median), max_impersonation, severity: one row per cluster of operations(host, root)."""
    m = operations.join(assets.select(F.col("id").alias("host"), "status", "confidence", F.coalesce("impersonation_score", F.lit(0)).alias("imp")), "host")
    live = F.col("status") == "ACTIVE"
    out = m.groupBy("root").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(live).alias("active"), F.bround(F.median(F.coalesce("confidence", F.lit(0)))).cast("int").alias("confidence"), F.max("imp").alias("max_impersonation"),
        F.count_if(live & (F.col("imp") >= 80)).alias("ah"), F.count_if(live & (F.col("imp") >= 60)).alias("am"), F.count_if(F.col("imp") >= 80).alias("nh"), F.count_if(F.col("imp") >= 30).alias("nl"))
    grade = severity(*(F.col(c) for c in ("ah", "am", "nh", "nl", "active", "members")))
    return out.select("root", "members", "active", "confidence", "max_impersonation", grade.alias("severity"))


def merge_clusters(clusters: DataFrame) -> DataFrame:
    """id, created_at, members: clusters(id, created_at, members) that overlap, directly or through others, become the oldest of them, with all their members."""
    from threadloom.operators.components import components

    each = clusters.select("id", "created_at", F.explode("members").alias("m"))
    found = components(each.select(F.concat(F.lit("c|"), F.col("id")).alias("u"), F.concat(F.lit("m|"), F.col("m")).alias("v")))
    rooted = each.join(found, F.concat(F.lit("c|"), F.col("id")) == found.node).select("root", "id", "created_at", "m")
    out = rooted.groupBy("root").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.min("created_at").alias("created_at"), F.array_sort(F.collect_set("m")).alias("members"))
    return out.select("id", "created_at", "members")

