"""Registered queries over artifacts, timelines, caches and clusters kept up to date, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import artifacts, correlation, incremental
from threadloom.plans.queries import DISTINCT, GROUPED, query
from threadloom.sources import driver
from threadloom.spark import materialise
from threadloom.streaming import events

ITEMS = """WITH items AS (
  SELECT CASE page_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'screenshot' ELSE 'provider:scan' END AS kind, 'inv_' || (page_id % 7) AS investigation_id, 'supplier-' || (page_id % 140) || '.example' AS asset_id, html AS content, 1704067200 + page_id * 977 % 864000 AS moment, page_id FROM pages
), stored AS (SELECT *, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256 FROM items)"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "page").when(k % 3 == 1, "screenshot").otherwise("provider:scan")
    items = driver.read(spark, d, "pages").select(kind.alias("kind"), F.concat(F.lit("inv_"), k % 7).alias("investigation_id"), F.concat(F.lit("supplier-"), k % 140, F.lit(".example")).alias("asset_id"), F.lit("text/html").alias("content_type"), F.col("html").alias("content"), F.timestamp_seconds(1704067200 + k * 977 % 864000).alias("created_at"), "page_id")
    return artifacts.stored(items)


@query(ITEMS + """ SELECT 'investigation' AS list, page_id, kind, sha256, CASE WHEN kind <> 'provider:scan' THEN size END AS shown FROM stored WHERE investigation_id = 'inv_3'
UNION ALL SELECT 'asset', page_id, kind, sha256, size FROM stored WHERE asset_id = 'supplier-11.example' AND kind = 'page'""", False)
def artifact_lists(spark: SparkSession, d: str) -> DataFrame:
    table = _stored(spark, d)
    shown = lambda df, name: df.select(F.lit(name).alias("list"), "page_id", "kind", "sha256", F.octet_length("content").cast("long").alias("shown"))
    return shown(artifacts.listed(table, investigation="inv_3", most=1 << 30), "investigation").unionByName(shown(artifacts.listed(table, asset="supplier-11.example", kind="page", most=1 << 30), "asset"))


@query(ITEMS + """ SELECT page_id, asset_id, s_suppkey AS supplier FROM (SELECT * FROM stored WHERE kind = 'screenshot' ORDER BY moment DESC, page_id LIMIT 12) LEFT JOIN supplier ON asset_id = 'supplier-' || s_suppkey || '.example'""", False)
def recent_screenshots(spark: SparkSession, d: str) -> DataFrame:
    assets = driver.read(spark, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey"), F.lit(".example")).alias("id"), F.col("s_suppkey").alias("value"), F.lit(None).cast("string").alias("status"))
    out = artifacts.recent_screenshots(_stored(spark, d).withColumn("id", F.col("page_id")), assets)
    return out.select(F.col("id").alias("page_id"), "asset_id", F.col("value").alias("supplier"))


@query("""WITH seen AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS moment FROM events
), stepped AS (SELECT *, moment - lag(moment) OVER (PARTITION BY user_id, event_type ORDER BY moment) AS pause FROM seen
), grouped AS (SELECT *, sum(CASE WHEN pause IS NULL OR pause > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM stepped)
SELECT user_id, event_type, min(moment) AS start, max(moment) AS stop, count(*) AS n FROM grouped GROUP BY user_id, event_type, run""", False)
def observed_spans(spark: SparkSession, d: str) -> DataFrame:
    seen = driver.read(spark, d, "events").select("user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return artifacts.spans(seen, ["user_id", "event_type"], "at", 21600)


@query("""WITH shots AS (SELECT c_custkey AS id, unnest(generate_series(1, c_custkey % 40)) AS i, 'scan' AS s FROM customer), listed AS (
  SELECT c_custkey AS id, 'wayback' AS source, i AS n, CASE WHEN i % 9 = 0 THEN NULL ELSE lpad(CAST(c_custkey * 7919 * i % 1000 AS VARCHAR), 3, '0') END AS time FROM customer, LATERAL (SELECT unnest(generate_series(1, c_custkey % 30)) AS i) WHERE i <= 24
  UNION ALL SELECT id, 'urlscan', i + 24, lpad(CAST(id * 104729 * i % 1000 AS VARCHAR), 3, '0') FROM shots WHERE i <= 30
)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY coalesce(time, '') DESC, n) - 1 AS INTEGER) AS place, source, time FROM listed""", False)
def host_history(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
    stamp = lambda n: F.lpad((n % 1000).cast("string"), 3, "0")
    snaps = F.transform(upto(k % 30), lambda i: F.struct(F.when(i % 9 != 0, stamp(k * 7919 * i)).alias("timestamp"), none.alias("archive_url"), none.alias("screenshot_url"), F.lit(200).alias("status")))
    shots = F.transform(upto(k % 40), lambda i: F.struct(stamp(k * 104729 * i).alias("time"), none.alias("url"), none.alias("screenshot")))
    seeds = driver.read(spark, d, "customer").select(k.alias("id"), snaps.alias("recent_snapshots"), shots.alias("historical_screenshots"))
    return artifacts.history(seeds).select("id", "place", "source", "time")


@query("""WITH told AS (
  SELECT event_id AS seq, event_type AS provider, 'k' || user_id % 20 AS key, CAST(floor(epoch(ts)) AS BIGINT) AS moment, CASE WHEN event_id % 5 = 0 THEN 'put' WHEN event_id % 17 = 0 THEN 'purge' ELSE 'get' END AS op, CAST(event_id AS VARCHAR) AS value, CAST(floor(epoch(ts)) AS BIGINT) + 3600 * (event_id % 7) AS expires_at FROM events
), last AS (SELECT *, max(CASE WHEN op <> 'get' THEN {'moment': moment, 'seq': seq, 'op': op, 'value': value, 'end': expires_at} END) OVER (PARTITION BY provider, key ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM told)
SELECT provider, key, seq, moment AS "at", CASE WHEN l.op = 'put' AND l.end > moment THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN l.op = 'put' AND l.end > moment THEN l.value END AS value FROM last WHERE op = 'get'""", False)
def cache_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e, n = driver.read(spark, d, "events"), F.col("event_id")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    told = e.select(n.alias("seq"), F.col("event_type").alias("provider"), F.concat(F.lit("k"), F.col("user_id") % 20).alias("key"), at.alias("at"), F.when(n % 5 == 0, "put").when(n % 17 == 0, "purge").otherwise("get").alias("op"), n.cast("string").alias("value"), (at + 3600 * (n % 7)).alias("expires_at"))
    return events.cache_outcomes(told)


@query(GROUPED + """, named AS (SELECT r.id AS node, min(root) AS c FROM reach r GROUP BY r.id), every AS (SELECT node, c FROM named UNION SELECT k.target, c FROM kept k JOIN named n ON k.source = n.node)
SELECT node, min(node) OVER (PARTITION BY c) AS least, count(*) OVER (PARTITION BY c) AS nodes FROM every""")
def incremental_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint edges in five batches by their id, each absorbed by the clusters of those before it; a row per node."""
    distinct = driver.relationships(spark, d).filter(F.col("type").isin(*DISTINCT))
    quiet = distinct.join(correlation.noisy_nodes(distinct, 150).select(F.col("node").alias("target")), "target", "left_anti")
    edges = materialise(quiet.select("id", F.col("source").alias("u"), F.col("target").alias("v")), "edges")
    labels, tombstones = incremental.empty(spark)
    for batch in range(5):
        part = edges.filter(F.pmod(F.crc32("id"), F.lit(5)) == batch)
        added, tombstones = incremental.absorb(labels, tombstones, part, batch)
        labels = labels.unionByName(added)
    now = materialise(incremental.current(labels, tombstones), "current")
    least = now.groupBy("cluster").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("nodes"))
    return now.join(least, "cluster").select("node", "least", "nodes")
