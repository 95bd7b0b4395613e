"""Property-graph operators over assets (id, type, value) and relationships (id, source, type, target)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.components import components, forests
from threadloom.spark import materialise

# How much an edge of a relation speaks for expanding its ends (any other: 2), and relations that do not.
EXPANSION = {
    "SHARES_ANALYTICS": 40, "SHARES_PIXEL": 40, "SHARES_TRACKING": 35, "SHARES_FAVICON": 30, "USES_CERTIFICATE": 25, "SHARES_CERTIFICATE": 25, "SHARES_LOGO": 25,
    "SIMILAR_HTML": 20, "SIMILAR_SCREENSHOT": 20, "REDIRECTS_TO": 30, "SUBDOMAIN_OF": 15, "RESOLVES_TO": 8, "HISTORICAL_RESOLUTION": 6, "OBSERVED_WITH": 5,
}
NOT_EXPANDED = ("USES_MX", "CNAME_TO", "USES_NAMESERVER")


def restrict(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose both ends are vertices."""
    for end in ("source", "target"):
        edges = edges.join(vertices.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def undirected(edges: DataFrame) -> DataFrame:
    """a, b: both directions of the distinct pairs, without loops."""
    one = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").distinct()
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: ends of all edges, parallel ones and both ends of loops counted."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, centrality: distinct neighbours by the number of other vertices; 0 for one that stands alone."""
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    near = undirected(edges).groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    out = vertices.join(near, vertices.id == near.a, "left").join(F.broadcast(n))  # n is one row
    return out.select("id", F.when(F.col("n") > 1, F.coalesce("k", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """n, m, density of the simple undirected graph: one row."""
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    m = undirected(edges).agg((F.count(F.lit(1)) / 2).cast("long").alias("m"))
    return n.join(F.broadcast(m)).select("n", "m", F.when(F.col("n") > 1, F.round(2 * F.col("m") / (F.col("n") * (F.col("n") - 1)), 5)).otherwise(0.0).alias("density"))


def shared_neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, types_a, types_b: nodes next to both a and b, with the sorted relation types to either."""
    each = edges.select("type", F.explode(F.array(F.struct(F.col("source").alias("x"), F.col("target").alias("id")), F.struct(F.col("target").alias("x"), F.col("source").alias("id")))).alias("e")).select("type", "e.*")
    of = lambda x, name: each.filter((F.col("x") == x) & ~F.col("id").isin(a, b)).groupBy("id").agg(F.array_sort(F.collect_set("type")).alias(name))
    return of(a, "types_a").join(of(b, "types_b"), "id")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, hops: what at most depth undirected steps from seeds(id) reach, with the fewest steps.

    Each step is a join from the newest nodes only, and written, so plans do not grow with depth.
    """
    pairs = undirected(edges)
    seen = materialise(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "hops")
    for hop in range(1, depth + 1):
        last = seen.filter(F.col("hops") == hop - 1).select(F.col("id").alias("a"))
        new = pairs.join(last, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = materialise(seen.unionByName(new.withColumn("hops", F.lit(hop))), "hops")
    return seen


def redirect_hosts(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """host: owners (HAS_URL) of the urls that share a component of REDIRECTS_TO with urls(id)."""
    hops = edges.filter("type = 'REDIRECTS_TO'").select(F.col("source").alias("u"), F.col("target").alias("v"))
    found = components(hops)
    roots = found.join(urls, found.node == urls.id, "left_semi").select("root").distinct()
    reached = found.join(roots, "root", "left_semi").select(F.col("node").alias("target")).unionByName(urls.select(F.col("id").alias("target"))).distinct()
    return edges.filter("type = 'HAS_URL'").join(reached, "target", "left_semi").select(F.col("source").alias("host")).distinct()


def operations(assets: DataFrame, edges: DataFrame, relations: tuple[str, ...], noisy_limit: int = 150, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """host, root, n: hosts (domain, ip) that fingerprints of the relations link, directly or on the way, with more than one to a group.

    A fingerprint with more than noisy_limit edges links nothing; hosts are not cut. Edges are shuffled once, by target;
    each task then leaves a forest of its nodes.

    With named, sources and targets are keys of two tables: ids of assets are those of sources, a target is named by type and
    key and is never a host. named makes a host's id of its key; key and group, a key for each root, are added.
    """
    distinct = edges.filter(F.col("type").isin(*relations)).select("source", "type", "target")
    hosts = assets.filter(F.col("type").isin("domain", "ip")).select("id")
    if named is None:
        known = hosts.distinct().select(F.col("id").alias("target"), F.lit(True).alias("is_host"))
        counted = distinct.join(known, "target", "left").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("target")))
        links = counted.filter((F.col("n") <= noisy_limit) | F.col("is_host")).select(F.col("source").alias("u"), F.col("target").alias("v"))
    else:
        of = W.partitionBy("target", "type")
        counted = distinct.withColumns({"n": F.count(F.lit(1)).over(of), "least": F.min("source").over(of)})
        links = counted.filter(F.col("n") <= noisy_limit).select(F.col("source").alias("u"), F.col("least").alias("v"))
    found = components(forests(links))
    placed = found.join(hosts, found.node == hosts.id, "left_semi").select(F.col("node").alias("key"), "root")
    placed = placed.withColumn("host", F.col("key") if named is None else named(F.col("key")))
    several = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("host").alias("first")).filter("n > 1")
    out = placed.join(several, "root")
    return out.select("host", F.col("first").alias("root"), "n", *([] if named is None else ["key", F.col("root").alias("group")]))


def expansion_strength(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, strength: the sum of EXPANSION over the edges of every node but seeds(id). Relations in NOT_EXPANDED do not count."""
    weight = F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*EXPANSION.items()))), F.col("type")), F.lit(2))
    ends = edges.filter(~F.col("type").isin(*NOT_EXPANDED)).select(F.explode(F.array("source", "target")).alias("id"), weight.alias("w"))
    return ends.join(seeds, "id", "left_anti").groupBy("id").agg(F.sum("w").alias("strength"))


def view(assets: DataFrame, edges: DataFrame, hidden_types: tuple[str, ...] = (), hidden_relations: tuple[str, ...] = (), members: DataFrame | None = None, min_confidence: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a view: without hidden types and relations, of hosts only members(id) and those of min_confidence or roots.

    Edges stay if both ends do. Where hosts are chosen by membership or confidence, other nodes stay only with an edge.
    """
    host = F.col("type").isin("domain", "ip")
    nodes = assets.filter(~F.col("type").isin(*hidden_types)) if hidden_types else assets
    if members is not None:
        nodes = nodes.join(members.select("id", F.lit(True).alias("is_member")), "id", "left").filter(~host | F.col("is_member")).drop("is_member")
    if min_confidence is not None:
        nodes = nodes.filter(~host | (F.coalesce("confidence", F.lit(0)) >= min_confidence) | F.coalesce("is_root", F.lit(False)))
    kept = restrict(edges.filter(~F.col("type").isin(*hidden_relations)) if hidden_relations else edges, nodes)
    if members is not None or min_confidence is not None:
        met = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        nodes = nodes.join(met.withColumn("met", F.lit(True)), "id", "left").filter(host | F.col("met")).drop("met")
    return nodes, kept


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """id, relation, other: each distinct neighbour of a node by relation; a relation that comes in is named in:relation."""
    out = edges.select(F.col("source").alias("id"), F.col("type").alias("relation"), F.col("target").alias("other"))
    into = edges.select(F.col("target").alias("id"), F.concat(F.lit("in:"), F.col("type")).alias("relation"), F.col("source").alias("other"))
    return out.unionByName(into).distinct()
