"""Registered queries over uploads, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import correlation, uploads
from threadloom.plans.queries import query
from threadloom.sources import driver
from threadloom.spark import materialise

#: 64 bits from the md5 of a name, as both engines make them.
H = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"
STORED = f"""WITH stored AS (
  SELECT c_custkey AS id, {H.format("c_name")} AS logo, [{H.format("c_mktsegment")}, xor({H.format("'x' || c_custkey % 50")}, CAST(c_custkey % 8 AS BIGINT))] AS logos, CASE WHEN c_custkey % 3 = 0 THEN xor({H.format("'f' || c_custkey % 9")}, CAST(c_custkey % 32 AS BIGINT)) END AS favicon,
         CASE WHEN c_custkey % 7 <> 0 THEN {H.format("'s' || c_nationkey")} END AS screenshot FROM customer
), asked AS (SELECT p_partkey AS upload, CASE p_partkey % 4 WHEN 0 THEN xor({H.format("'x' || p_partkey % 50")}, 5) WHEN 1 THEN xor({H.format("'f' || p_partkey % 9")}, 48) WHEN 2 THEN xor({H.format("'s' || p_partkey % 25")}, 7) ELSE {H.format("'none' || p_partkey")} END AS g FROM part WHERE p_partkey % 20 < 4
), pictures AS (
  SELECT id, 0 AS rank, 'logo' AS via, logo AS h FROM stored UNION ALL SELECT id, 0, 'logo', unnest(logos) FROM stored UNION ALL SELECT id, 1, 'favicon', favicon FROM stored UNION ALL SELECT id, 2, 'screenshot', screenshot FROM stored
)"""


def _hash(name) -> F.Column:
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    named = lambda head, x: _hash(F.concat(F.lit(head), x.cast("string")))
    return driver.read(spark, d, "customer").select(
        k.alias("id"), _hash(F.col("c_name")).alias("logo"), F.array(_hash(F.col("c_mktsegment")), named("x", k % 50).bitwiseXOR(k % 8)).alias("logos"),
        F.when(k % 3 == 0, named("f", k % 9).bitwiseXOR(k % 32)).alias("favicon"), F.when(k % 7 != 0, named("s", F.col("c_nationkey"))).alias("screenshot"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    named = lambda head, x, mask: _hash(F.concat(F.lit(head), x.cast("string"))).bitwiseXOR(F.lit(mask).cast("long"))
    g = F.when(k % 4 == 0, named("x", k % 50, 5)).when(k % 4 == 1, named("f", k % 9, 48)).when(k % 4 == 2, named("s", k % 25, 7)).otherwise(named("none", k, 0))
    return driver.read(spark, d, "part").filter(k % 20 < 4).select(k.alias("upload"), g.alias("g"))


@query(STORED + """, best AS (
  SELECT upload, id, min({'bits': bit_count(xor(h, g)), 'rank': rank, 'via': via}) AS b FROM asked JOIN pictures ON bit_count(xor(h, g)) <= 7 GROUP BY upload, id
)
SELECT upload, id, b.via AS via, 1 - b.bits / 64.0 AS similarity, CAST(row_number() OVER (PARTITION BY upload ORDER BY b.bits, id) AS INTEGER) AS place FROM best QUALIFY place <= 100""", False)
def nearest_pictures(spark: SparkSession, d: str) -> DataFrame:
    stored = materialise(uploads.pictures(_stored(spark, d)), "pictures")
    return uploads.nearest_pictures(stored, _asked(spark, d), 0.88)


@query("""WITH stored AS (
  SELECT s_suppkey AS id, t.trackers, substr(md5('t' || s_suppkey % 30), 1, 8) AS title, xor(s_suppkey % 9 * 123456789123456789, CAST(s_suppkey % 16 AS BIGINT)) AS html
  FROM supplier LEFT JOIN (SELECT l_suppkey, list(DISTINCT 'UA-' || (l_partkey % 3000)) AS trackers FROM lineitem WHERE l_linenumber > 4 GROUP BY l_suppkey) t ON s_suppkey = l_suppkey
), asked AS (SELECT id AS upload, list_filter(trackers, lambda x: ends_with(x, '7')) AS trackers, title, xor(html, 3) AS html FROM stored WHERE id % 20 = 0
), shared AS (SELECT upload, id, list_sort(list_intersect(s.trackers, a.trackers)) AS shared FROM stored s JOIN asked a ON len(list_intersect(s.trackers, a.trackers)) > 0 QUALIFY row_number() OVER (PARTITION BY upload ORDER BY id) <= 30
), titled AS (SELECT upload, id FROM stored s JOIN asked a ON s.title = a.title QUALIFY row_number() OVER (PARTITION BY upload ORDER BY id) <= 30
), alike AS (SELECT upload, id, bit_count(xor(s.html, a.html)) AS bits FROM stored s JOIN asked a ON bit_count(xor(s.html, a.html)) <= 6 QUALIFY row_number() OVER (PARTITION BY upload ORDER BY bits, id) <= 30
), every AS (SELECT upload, id, 0 AS rank, 'tracking_id' AS via, 1.0 AS similarity, array_to_string(shared, ',') AS shared FROM shared UNION ALL SELECT upload, id, 1, 'title', 1.0, '' FROM titled UNION ALL SELECT upload, id, 2, 'structure', 1 - bits / 64.0, '' FROM alike)
SELECT upload, id, arg_min(via, rank) AS via, CAST(arg_min(similarity, rank) AS DOUBLE) AS similarity, arg_min(shared, rank) AS shared FROM every GROUP BY upload, id""", False)
def uploaded_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    seen = driver.read(spark, d, "lineitem").filter("l_linenumber > 4").groupBy("l_suppkey").agg(F.collect_set((F.col("l_partkey") % 3000).cast("int")).alias("trackers"))
    seen = seen.withColumn("trackers", F.transform("trackers", lambda t: F.concat(F.lit("UA-"), t)))
    html = (k % 9 * F.lit(123456789123456789)).bitwiseXOR((k % 16).cast("long"))
    stored = driver.read(spark, d, "supplier").join(seen, k == F.col("l_suppkey"), "left").select(k.alias("id"), "trackers", F.substring(F.md5(F.concat(F.lit("t"), k % 30)), 1, 8).alias("title_hash"), html.alias("html"))
    stored = materialise(stored, "stored_pages")
    asked = stored.filter("id % 20 = 0").select(F.col("id").alias("upload"), F.filter("trackers", lambda t: t.endswith("7")).alias("trackers"), "title_hash", F.col("html").bitwiseXOR(F.lit(3).cast("long")).alias("html"))
    return uploads.page_matches(stored, asked, most=30).withColumn("shared", F.array_join("shared", ","))


@query("""WITH signs AS (SELECT vec_id, list_sum(list_transform(embedding[1:20], lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS BIGINT) << CAST(3 * (i - 1) AS INTEGER) ELSE 0 END)) AS h FROM embeddings)
SELECT CAST(g.h AS BIGINT) AS g, count(*) AS near, CAST(min(bit_count(xor(CAST(s.h AS BIGINT), CAST(g.h AS BIGINT)))) AS INTEGER) AS least FROM (SELECT DISTINCT h FROM signs) s JOIN (SELECT DISTINCT h FROM signs WHERE vec_id % 20 = 0) g
  ON bit_count(xor(CAST(s.h AS BIGINT), CAST(g.h AS BIGINT))) BETWEEN 1 AND 3 GROUP BY g.h""", False)
def near_signs(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by the signs of their first 20 numbers, spread over a hash: how many other signs lie within 3 of each asked one."""
    bits = F.transform(F.slice("embedding", 1, 20), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), 3 * i).cast("long")).otherwise(F.lit(0).cast("long")))
    signs = driver.read(spark, d, "embeddings").select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b).alias("h"))
    close = correlation.hamming_search(signs, signs.filter("vec_id % 20 = 0").select(F.col("h").alias("g")), 3).filter("bits > 0")
    return close.groupBy("g").agg(F.count(F.lit(1)).alias("near"), F.min("bits").alias("least"))
