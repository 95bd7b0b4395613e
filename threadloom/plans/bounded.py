"""Registered queries over bounded graph loading, public suffixes and provider pivots, each with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import expansion, pivots, suffixes
from threadloom.operators.graph import EXPANSION, NOT_EXPANDED
from threadloom.plans.queries import _graph, query
from threadloom.sources import driver
from threadloom.spark import materialise

BUDGETS, QUOTA = (20, 60, 400), 25
WEIGHT = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EXPANSION.items()) + " ELSE 2 END"


def _expansion_sql(budget: int) -> str:
    step = """, c{h} AS (
  SELECT p.id, sum(p.w) AS strength, arg_min(p.f, [-p.w, 0]) AS one, min({{'w': -p.w, 'f': p.f, 'seed': t.seed}}) AS best FROM pairs p JOIN t{g} t ON p.f = t.id AND t.hops = {g} WHERE p.id NOT IN (SELECT id FROM t{g}) GROUP BY p.id
), q{h} AS (
  SELECT id, strength, best.f AS via, best.seed AS seed FROM c{h} QUALIFY row_number() OVER (PARTITION BY best.seed ORDER BY strength DESC, id) <= {q}
), t{h} AS (
  SELECT * FROM t{g} UNION ALL
  SELECT id, {h}, strength, via, seed FROM (SELECT *, row_number() OVER (ORDER BY strength DESC, id) AS n FROM q{h}) WHERE n <= {b} - (SELECT count(*) FROM t{g})
)"""
    first = f"""WITH t0 AS (SELECT id, 0 AS hops, 0 AS strength, CAST(NULL AS VARCHAR) AS via, id AS seed FROM assets WHERE is_root ORDER BY id LIMIT {budget})"""
    steps = "".join(step.format(h=h, g=h - 1, q=QUOTA, b=budget) for h in (1, 2))
    return f"({first}{steps} SELECT {budget} AS budget, id, CAST(hops AS INTEGER) AS hops, CAST(strength AS BIGINT) AS strength, via, seed FROM t2)"


@query(f""", ends AS (
  SELECT source AS a, target AS b, {WEIGHT} AS w FROM edges WHERE source <> target AND type NOT IN {NOT_EXPANDED}
), pairs AS (SELECT f, id, sum(w) AS w FROM (SELECT a AS f, b AS id, w FROM ends UNION ALL SELECT b, a, w FROM ends) GROUP BY f, id)
""" + " UNION ALL ".join("SELECT * FROM " + _expansion_sql(b) for b in BUDGETS))  # fmt: skip
def bounded_expansion(spark: SparkSession, d: str) -> DataFrame:
    assets, edges = _graph(spark, d)
    seeds = assets.filter("is_root")
    each = [expansion.expand(edges, seeds, b, quota=QUOTA).select(F.lit(b).alias("budget"), "id", "hops", "strength", "via", "seed") for b in BUDGETS]
    return reduce(DataFrame.unionByName, each)


LOADED = """, nodes AS (SELECT id, type, value FROM assets WHERE list_contains(investigation_ids, 'inv_3') OR id IN (SELECT target FROM edges WHERE list_contains(investigation_ids, 'inv_3')) ORDER BY id LIMIT 150
), kept AS (SELECT * FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"""


def _loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    assets, edges = _graph(spark, d)
    mine = lambda df: df.filter(F.array_contains("investigation_ids", "inv_3"))
    ids = mine(assets).select("id").unionByName(mine(edges).select(F.col("target").alias("id")))
    nodes, kept = expansion.load(assets, edges, ids, 150)
    return expansion.payload(materialise(nodes, "loaded"), kept, assets.filter("is_root"))


@query(LOADED + """ SELECT n.id, n.value AS label, n.type AS kind, (SELECT count(*) FROM kept k WHERE k.source = n.id) + (SELECT count(*) FROM kept k WHERE k.target = n.id) AS degree, a.is_root AS focus FROM nodes n JOIN assets a ON n.id = a.id""")
def investigation_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d)[0]


@query(LOADED + f""" SELECT id, source, target, type AS relation, CAST({WEIGHT} AS BIGINT) AS weight FROM kept""")
def investigation_edges(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d)[1]


@query(LOADED + """ SELECT n AS nodes, m AS edges, k AS kinds, CASE WHEN n > 1 THEN round(2.0 * pairs / (n * (n - 1)), 5) ELSE 0.0 END AS density
FROM (SELECT count(*) AS n, count(DISTINCT type) AS k FROM nodes), (SELECT count(*) AS m FROM kept), (SELECT count(DISTINCT [least(source, target), greatest(source, target)]) AS pairs FROM kept WHERE source <> target)""")
def investigation_stats(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d)[2]


@query(""", chosen AS (SELECT id FROM assets WHERE is_root)
SELECT id FROM chosen UNION SELECT target FROM edges WHERE source IN (SELECT id FROM chosen) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM chosen)""")
def highlighted_nodes(spark: SparkSession, d: str) -> DataFrame:
    assets, edges = _graph(spark, d)
    return expansion.highlighted(edges, assets.filter("is_root"))


@query(""", numbered AS (SELECT id, ascii(substr(id, 1, 1)) AS c FROM assets)
SELECT id, CASE WHEN c % 5 = 0 THEN 'removed' WHEN c % 5 = 1 THEN 'added' ELSE 'changed' END AS change FROM numbered n WHERE c % 5 < 2 OR EXISTS (SELECT 1 FROM assets a WHERE a.id = n.id AND confidence > 90)""")
def graph_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the assets: one lacks a fifth, the other another fifth, and high confidence has fallen."""
    assets = _graph(spark, d)[0]
    c = F.ascii(F.substring("id", 1, 1)) % 5
    new = assets.filter(c != 0).withColumn("confidence", F.when(F.col("confidence") > 90, 0).otherwise(F.col("confidence")))
    return expansion.difference(assets.filter(c != 1), new)


@query(""", numbered AS (SELECT *, ascii(substr(id, 1, 1)) % 5 AS c FROM assets)
SELECT id, type, coalesce(CASE WHEN c = 1 THEN status ELSE 'shown' END, 'none') AS status FROM numbered WHERE c < 3""")
def merged_views(spark: SparkSession, d: str) -> DataFrame:
    """A view that shows three fifths less one of the assets, and a load that brings that one and others shown before."""
    assets = _graph(spark, d)[0].select("id", "type", "status").withColumn("c", F.ascii(F.substring("id", 1, 1)) % 5)
    shown = assets.filter(F.col("c").isin(0, 2)).withColumn("status", F.lit("shown"))
    return expansion.merged_payload(shown, assets.filter(F.col("c").isin(0, 1))).select("id", "type", F.coalesce("status", F.lit("none")).alias("status"))


#: Lines of a public-suffix list with all its kinds of rules, for hosts made of customers.
RULES = ["// a comment", "", "com", "org", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "github.io", "io", "Net  with a remark"]
TAILS = ["com", "co.uk", "uk", "kawasaki.jp", "b.kawasaki.jp", "city.kawasaki.jp", "www.ck", "foo.ck", "ck", "github.io", "NET.", "unknown", "cloudflare.com", "cdn.amazonaws.com", "GStatic.com"]
HOSTS = """, hosts AS (
  SELECT DISTINCT host, lower(rtrim(host, '.')) AS h FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'www.shop' || (c_custkey % 97) || '.' ELSE 'shop' || (c_custkey % 89) || '.' END || (%s)[c_custkey %% 15 + 1] AS host FROM customer)
), rules(base, kind) AS (VALUES ('com', 0), ('org', 0), ('uk', 0), ('co.uk', 0), ('jp', 0), ('kawasaki.jp', 1), ('city.kawasaki.jp', -1), ('ck', 1), ('www.ck', -1), ('github.io', 0), ('io', 0), ('net', 0)
), owned AS (
  SELECT host, h, string_split(h, '.') AS ls, (SELECT max({'e': kind < 0, 'n': len(string_split(base, '.')) + kind}) FROM rules WHERE (h = base OR ends_with(h, '.' || base)) AND len(string_split(base, '.')) + kind <= len(string_split(h, '.'))).n AS n FROM hosts
), found AS (SELECT host, CASE WHEN n IS NULL OR n >= len(ls) THEN h ELSE array_to_string(ls[len(ls) - n:], '.') END AS registrable FROM owned)""".replace("c_custkey % 4", "c_custkey %% 4").replace("c_custkey % 97", "c_custkey %% 97").replace("c_custkey % 89", "c_custkey %% 89") % repr(TAILS)  # fmt: skip


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    head = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("www.shop"), k % 97, F.lit("."))).otherwise(F.concat(F.lit("shop"), k % 89, F.lit(".")))
    return driver.read(spark, d, "customer").select(F.concat(head, F.element_at(F.array(*map(F.lit, TAILS)), (k % 15 + 1).cast("int"))).alias("host"))


@query(HOSTS + " SELECT host, registrable FROM found")
def registrable_domains(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.registrable(_hosts(spark, d), suffixes.rules(spark, RULES))


@query(HOSTS + f" SELECT host FROM found WHERE registrable NOT IN {suffixes.KNOWN_INFRASTRUCTURE}")
def own_hosts(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.without_known(_hosts(spark, d).distinct(), suffixes.rules(spark, RULES), "host")


def _pivots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What is asked for the roots, and the providers: nations that take kinds by their number."""
    k = F.col("s_suppkey")
    lines = driver.read(spark, d, "lineitem").filter("l_suppkey % 50 = 1").select("l_suppkey", (F.col("l_partkey") % 20 + 1).alias("t")).distinct()  # those of roots
    parts = lines.groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("part-"), "t"))).alias("tracking_ids"))
    roots = driver.read(spark, d, "supplier").filter(k % 50 == 1)
    seeds = roots.join(parts, roots.s_suppkey == parts.l_suppkey, "left").select(
        X.node_id(F.lit("domain"), F.concat(F.lit("supplier-"), k, F.lit(".example"))).alias("seed"), F.concat(F.lit("supplier-"), k, F.lit(".example")).alias("seed_value"), F.concat(F.lit("part-"), k % 60 + 1).alias("cert_sha256"),
        F.when(k % 100 == 1, F.concat(F.lit("sha1-"), k)).alias("cert_sha1"), F.lit("").alias("favicon_mmh3"), F.concat(F.lit("fav-"), k).alias("favicon_sha256"), F.when(k % 3 == 0, F.col("s_name")).alias("title"), "tracking_ids")
    n = F.col("n_nationkey")
    kinds = F.filter(F.array(F.when(n % 2 == 0, "cert_sha256"), F.when(n % 3 == 0, "cert_sha1"), F.when(n % 5 == 0, "title"), F.when(n % 4 == 1, "tracking_id"), F.when(n % 6 == 1, "favicon_sha256")), lambda x: x.isNotNull())
    providers = driver.read(spark, d, "nation").select(F.col("n_name").alias("name"), n.alias("key"), kinds.alias("types"), (n % 7 != 3).alias("enabled"), (n % 8 == 0).alias("credit"), (n % 3).alias("priority"), F.when(n % 2 == 0, "scan").otherwise("search").alias("category"))
    return seeds, providers


ASKED = """, roots AS (SELECT s_suppkey AS k, s_name, 'supplier-' || s_suppkey || '.example' AS seed_value, substr(sha256('domain|supplier-' || s_suppkey || '.example'), 1, 24) AS seed FROM supplier WHERE s_suppkey % 50 = 1
), trackers AS (SELECT l_suppkey, list_sort(list(DISTINCT 'part-' || (l_partkey % 20 + 1)))[1:5] AS ts FROM lineitem GROUP BY l_suppkey), asked AS (
  SELECT seed, seed_value, 'cert_sha256' AS kind, 'part-' || (k % 60 + 1) AS value, 'part-' || (k % 60 + 1) AS node_value FROM roots
  UNION ALL SELECT seed, seed_value, 'cert_sha1', 'sha1-' || k, 'part-' || (k % 60 + 1) FROM roots WHERE k % 100 = 1
  UNION ALL SELECT seed, seed_value, 'favicon_sha256', 'fav-' || k, '' FROM roots
  UNION ALL SELECT seed, seed_value, 'title', s_name, NULL FROM roots WHERE k % 3 = 0
  UNION ALL SELECT seed, seed_value, 'tracking_id', unnest(ts), unnest(ts) FROM roots JOIN trackers ON k = l_suppkey
), providers AS (
  SELECT n_name AS name, n_nationkey AS n, list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'cert_sha256' END, CASE WHEN n_nationkey % 3 = 0 THEN 'cert_sha1' END, CASE WHEN n_nationkey % 5 = 0 THEN 'title' END, CASE WHEN n_nationkey % 4 = 1 THEN 'tracking_id' END,
         CASE WHEN n_nationkey % 6 = 1 THEN 'favicon_sha256' END], lambda x: x IS NOT NULL) AS types FROM nation WHERE n_nationkey % 7 <> 3 AND n_nationkey % 8 <> 0
), sent AS (SELECT a.*, p.name AS provider, p.n FROM asked a JOIN providers p ON list_contains(p.types, a.kind))"""


@query(ASKED + " SELECT seed, kind, value, node_value, provider FROM sent")
def pivot_fan_out(spark: SparkSession, d: str) -> DataFrame:
    seeds, providers = _pivots(spark, d)
    return pivots.fan_out(pivots.asked(seeds), providers, credits=False)


@query(ASKED + """, listed AS (
  SELECT c_nationkey, c_custkey % 10 AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, c_custkey FROM customer
), hits AS (
  SELECT s.*, CASE WHEN k = 2 THEN 'ip' ELSE 'domain' END AS type, CASE WHEN k = 0 THEN 'x' || c_custkey || '.google.com' WHEN k = 1 THEN 'no domain ' || c_custkey WHEN k = 2 THEN '10.0.0.' || (c_custkey % 256) WHEN k = 3 THEN ' ' WHEN k = 4 THEN own ELSE 'c' || c_custkey || '.com' END AS found
  FROM (SELECT *, min(seed_value) OVER (PARTITION BY kind, value, provider) AS own FROM sent) s JOIN listed l ON s.n = l.c_nationkey AND pos <= 150 WHERE k NOT IN (0, 1, 3) AND NOT (k = 4 AND own = seed_value)
), nodes AS (SELECT kind, node_value, min(id) AS node FROM (SELECT DISTINCT kind, node_value FROM sent) s JOIN assets a ON a.value = s.node_value
  AND list_contains(CASE kind WHEN 'tracking_id' THEN ['analytics', 'pixel', 'tracking'] WHEN 'title' THEN [] WHEN 'favicon_sha256' THEN ['favicon'] ELSE ['certificate'] END, a.type) GROUP BY kind, node_value
)
SELECT substr(sha256(type || '|' || found), 1, 24) AS source, 'OBSERVED_WITH' AS relation, coalesce(node, seed) AS target, type, found AS value, min({'provider': provider, 'pivot': h.kind}).provider AS provider, min({'provider': provider, 'pivot': h.kind}).pivot AS pivot
FROM hits h LEFT JOIN nodes n ON h.kind = n.kind AND h.node_value = n.node_value GROUP BY ALL""")
def pivot_edges(spark: SparkSession, d: str) -> DataFrame:
    seeds, providers = _pivots(spark, d)
    seeds = materialise(seeds, "seeds")
    sent = pivots.fan_out(pivots.asked(seeds), providers, credits=False).join(seeds.select("seed", "seed_value"), "seed")
    k = F.col("c_custkey")
    value = F.when(k % 10 == 0, F.concat(F.lit("x"), k, F.lit(".google.com"))).when(k % 10 == 1, F.concat(F.lit("no domain "), k)).when(k % 10 == 2, F.concat(F.lit("10.0.0."), k % 256)).when(k % 10 == 3, " ").otherwise(F.concat(F.lit("c"), k, F.lit(".com")))
    entity = F.struct(k, F.when(k % 10 == 2, "ip").otherwise("domain").alias("type"), value.alias("value"), F.lit("OBSERVED_WITH").alias("relation"))
    first = W.partitionBy("c_nationkey").orderBy("c_custkey")  # no more of an answer count
    few = driver.read(spark, d, "customer").select("c_nationkey", k).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= pivots.MOST_ENTITIES)
    listed = few.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(entity)).alias("all"))
    asked = sent.select("kind", "value", "provider", "seed_value").groupBy("kind", "value", "provider").agg(F.min("seed_value").alias("own"))
    named = asked.join(providers.select(F.col("name").alias("provider"), "key"), "provider").join(listed, F.col("key") == F.col("c_nationkey"))
    related = F.transform("all", lambda e: F.struct(e["type"].alias("type"), F.when(e["c_custkey"] % 10 == 4, F.col("own")).otherwise(e["value"]).alias("value"), e["relation"].alias("relation")))
    return pivots.attached(sent, named.select("kind", "value", "provider", related.alias("related")), driver.assets(spark, d), suffixes.rules(spark, ["com", "example"]))
