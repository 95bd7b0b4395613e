"""Clusters of hosts: members, fingerprints, confidence, evidence, names, and their nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import HOST_TYPES, RELATION_FEATURES, Scoring
from threadloom.functions.text import edge_id, node_id
from threadloom.operators.correlation import _lookup
from threadloom.operators.graph import degrees, undirected

#: Relations between hosts that are evidence by themselves.
HOST_RELATIONS = {"SHARES_CERTIFICATE": "certificate", "SIMILAR_HTML": "html", "SIMILAR_SCREENSHOT": "screenshot", "REDIRECTS_TO": "redirect"}


def members(scores: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """host, score: of scores(host, score) those that reach cluster_min; none if there is only one."""
    found = scores.filter(F.col("score") >= (scoring or Scoring()).cluster_min).select("host", "score")
    n = found.agg(F.count(F.lit(1)).alias("n"))  # one row
    return found.join(F.broadcast(n)).filter("n > 1").drop("n")


def fingerprints(found: DataFrame, assets: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n: nodes next to two or more of found(host), for an IP one; hosts of the cluster, URLs, clusters and domains are none."""
    near = undirected(edges).join(found.select(F.col("host").alias("b")), "b", "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    kinds = assets.filter(~F.col("type").isin("url", "cluster", "domain")).join(found.select(F.col("host").alias("id")), "id", "left_anti").select("id", "type")
    return kinds.join(near, kinds.id == near.a).filter("n >= 2 OR type = 'ip'").select("id", "n")


def confidence(found: DataFrame, seeds: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """confidence: the rounded median score of found(host, score) without seeds(host), or cluster_min if there is no other. One row."""
    median = F.bround(F.median("score")).cast("int")
    return found.join(seeds, "host", "left_anti").agg(F.coalesce(median, F.lit((scoring or Scoring()).cluster_min)).alias("confidence"))


def feature_frequency(matches: DataFrame, found: DataFrame) -> DataFrame:
    """feature, members: how many of found(host) have each feature of matches(host, feature)."""
    return matches.join(found.select("host"), "host", "left_semi").select("host", "feature").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("members"))


def merge_evidence(*lists: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, feature, members: of lists(keys, feature, members) the greatest count of each feature."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.groupBy(*keys, "feature").agg(F.max("members").alias("members"))


def host_evidence(operations: DataFrame, assets: DataFrame, edges: DataFrame) -> DataFrame:
    """root, host, feature: what each host of operations(host, root) shares within its cluster.

    A fingerprint counts if two hosts of the cluster carry it, a host-to-host relation by itself; tracker
    containers (GTM-) are feature gtm.
    """
    known = edges.filter(F.col("type").isin(*RELATION_FEATURES, *HOST_RELATIONS)).select("source", "target", _lookup(RELATION_FEATURES | HOST_RELATIONS, F.col("type")).alias("feature"))
    ways = known.unionByName(known.select(F.col("target").alias("source"), F.col("source").alias("target"), "feature"))
    mine = operations.select("root", "host")
    near = mine.join(ways, mine.host == ways.source).select("root", "host", "feature", F.col("target").alias("node")).distinct()
    kinds = assets.select(F.col("id").alias("node"), F.col("type").isin(*HOST_TYPES).alias("is_host"), (F.upper("value").startswith("GTM-")).alias("gtm"))
    near = near.join(kinds, "node")
    shared = near.filter("NOT is_host").groupBy("root", "node").agg(F.count_distinct("host").alias("n")).filter("n > 1").select("root", "node")
    prints = near.filter("NOT is_host").join(shared, ["root", "node"]).select("root", "host", F.when(F.col("gtm") & (F.col("feature") == "tracking"), "gtm").otherwise(F.col("feature")).alias("feature"))
    return prints.unionByName(near.filter("is_host").select("root", "host", "feature")).distinct()


def carried(prints: DataFrame) -> DataFrame:
    """group, key, features, degree of prints(group, key, type, target), the fingerprint edges of the keys of clusters: the features of those targets that two keys of the group carry, and the number of edges.

    A target is named by type and key. Each task sums a key up to a row before the shuffle, features as bits.
    """
    from pyspark.sql import Window as W

    names = sorted(set(RELATION_FEATURES.values()))
    bit = _lookup({r: 1 << names.index(f) for r, f in RELATION_FEATURES.items()}, F.col("type"))
    of = W.partitionBy("group", "target", "type")
    several = F.min("key").over(of) < F.max("key").over(of)
    met = prints.withColumn("bit", F.when(several, bit).otherwise(0)).groupBy("group", "key").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("degree"))
    features = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << i) > 0, f) for i, f in enumerate(names))))
    return met.select("group", "key", features.alias("features"), "degree")


def rebuilt(operations: DataFrame, assets: DataFrame, edges: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """root, members, confidence, name: the mean of the hosts' weights, 100 at most for each, and the value of the host with the most edges."""
    return rated(operations, assets, degrees(edges), host_evidence(operations, assets, edges), scoring)


def rated(operations: DataFrame, assets: DataFrame, degree: DataFrame, evidence: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """What rebuilt() gives, from degree(id, degree) and evidence(root, host, feature)."""
    scoring = scoring or Scoring()
    found = evidence.groupBy("root", "host").agg(F.least(F.sum(_lookup(scoring.weights, F.col("feature"))), F.lit(100.0)).alias("score"))
    named = assets.select(F.col("id").alias("host"), "value")
    hosts = operations.select("root", "host").join(named, "host").join(degree.withColumnRenamed("id", "host"), "host", "left").join(found, ["root", "host"], "left")
    top = F.min_by("value", F.struct(-F.coalesce("degree", F.lit(0)), F.col("value")))
    out = hosts.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.bround(F.avg(F.coalesce("score", F.lit(0.0)))).cast("int").alias("confidence"), top.alias("top"))
    return out.select("root", "members", "confidence", F.concat(F.lit("Operation around "), "top").alias("name"))


def breakdown(operations: DataFrame, assets: DataFrame) -> DataFrame:
    """root, status, n, place: how many hosts of each cluster have each status (null is UNKNOWN), and its place by falling count and name."""
    from pyspark.sql import Window as W

    hosts = operations.select("root", F.col("host").alias("id")).join(assets.select("id", F.coalesce("status", F.lit("UNKNOWN")).alias("status")), "id")
    counts = hosts.groupBy("root", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy(F.desc("n"), "status")))


def as_graph(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, type, value), edges(id, source, type, target)): a node for each root and an edge MEMBER_OF_CLUSTER from each host to it."""
    node = node_id(F.lit("cluster"), F.col("root"))
    nodes = operations.select("root").distinct().select(node.alias("id"), F.lit("cluster").alias("type"), F.col("root").alias("value"))
    edges = operations.select(F.col("host").alias("source"), F.lit("MEMBER_OF_CLUSTER").alias("type"), node.alias("target"))
    return nodes, edges.select(edge_id(F.col("source"), F.col("type"), F.col("target")).alias("id"), "source", "type", "target")


def url_confidence(scores: DataFrame, edges: DataFrame, urls: DataFrame) -> DataFrame:
    """id, confidence: each of urls(id, confidence) with the greatest of its own and its hosts' scores(host, score)."""
    best = edges.filter("type = 'HAS_URL'").join(scores.select(F.col("host").alias("source"), "score"), "source").groupBy(F.col("target").alias("id")).agg(F.max("score").alias("score"))
    return urls.join(best, "id", "left").select("id", F.greatest(F.coalesce("confidence", F.lit(0)), F.coalesce("score", F.lit(0))).alias("confidence"))
