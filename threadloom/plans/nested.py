"""Registered queries over nested records, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import records
from threadloom.plans.queries import query
from threadloom.sources import driver


def _object(**members: Column) -> Column:
    """A VARIANT object; null members are written as null."""
    return F.parse_json(F.to_json(F.struct(*(c.alias(n) for n, c in members.items())), {"ignoreNullFields": "false"}))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """key, order columns and record of every line: what was seen of a host. Some members are null, some are now an object and now a text."""
    n = F.col("l_linenumber")
    web = F.struct(F.col("l_linestatus").alias("status"), F.when(n % 3 == 0, F.col("l_returnflag")).alias("title"), F.struct(F.col("l_quantity").cast("long").alias("bytes"), F.when(n % 2 == 0, n).alias("lines")).alias("size"))
    tags = F.when(n == 1, F.array("l_returnflag", F.col("l_linestatus")))
    sent = F.when(n == 5, F.parse_json(F.to_json(F.struct(F.col("l_returnflag").alias("to"))))).when(n == 6, F.parse_json(F.to_json(F.struct((F.col("l_partkey") % 9).alias("code"))))).when(n == 7, F.parse_json(F.lit('"plain"')))
    return driver.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", _object(web=web, tags=tags, redirect=sent).alias("record"))


#: The same lines for DuckDB, numbered per host in order.
LINES = """
WITH lines AS (
  SELECT l_suppkey AS key, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS ord, l_linenumber AS n, l_linestatus AS status, l_returnflag AS flag,
         CAST(l_quantity AS BIGINT) AS bytes, l_partkey % 9 AS code FROM lineitem
)"""


@query(LINES + """, plain AS (SELECT key AS k, max(ord) FILTER (n = 7) AS p FROM lines GROUP BY key), latest AS (
  SELECT key, arg_max(status, ord) AS status, arg_max(flag, ord) FILTER (n % 3 = 0) AS title, arg_max(bytes, ord) AS bytes, arg_max(n, ord) FILTER (n % 2 = 0) AS evens,
         arg_max([flag, status], ord) FILTER (n = 1) AS tags, arg_max(flag, ord) FILTER (n = 5 AND ord > coalesce(p, 0)) AS moved, arg_max(code, ord) FILTER (n = 6 AND ord > coalesce(p, 0)) AS code, max(p) AS p,
         coalesce(bool_or(n IN (5, 6) AND ord > coalesce(p, 0)), false) AS goes
  FROM lines JOIN plain ON key = k GROUP BY key
)
SELECT coalesce(key, s_suppkey) AS key, CAST(json_merge_patch(json_object('nation', s_nationkey), json_object('redirect', CASE WHEN goes THEN json_object('code', code, 'to', moved) WHEN p IS NOT NULL THEN to_json('plain') END,
       'tags', coalesce(tags, ['seed']), 'web', CASE WHEN key IS NULL THEN json_object('title', s_name) ELSE json_object('size', json_object('bytes', bytes, 'lines', evens), 'status', status, 'title', coalesce(title, s_name)) END)) AS VARCHAR) AS record
FROM supplier FULL JOIN latest ON key = s_suppkey""", False)
def upsert_records(spark: SparkSession, d: str) -> DataFrame:
    seed = _object(nation=F.col("s_nationkey"), tags=F.array(F.lit("seed")), web=F.struct(F.col("s_name").alias("title")))
    old = driver.read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), seed.alias("record"))
    out = records.upsert(old, _observed(spark, d), ["key"], "record", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("key", F.to_json("record").alias("record"))


@query("""WITH runs AS (
  SELECT 'user' || user_id AS id, event_type AS provider, event_id AS run, event_type <> 'error' AND event_id % 11 <> 0 AS ok, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), latest AS (SELECT id, provider, max(run) AS run, arg_max(k, run) AS k FROM runs WHERE ok GROUP BY id, provider)
SELECT u.id, coalesce(string_agg(provider, ',' ORDER BY provider), '') AS sources,
       '{' || CASE WHEN count(provider) > 0 THEN '"enrichment":{' || string_agg('"' || provider || '":{"_fetched_at":' || run || CASE WHEN k % 2 = 0 THEN ',"detail":{"k":' || k || '}' ELSE ',"odd":' || k END || '}', ',' ORDER BY provider) || '},' ELSE '' END || '"seen":true}' AS record
FROM (SELECT DISTINCT id FROM runs) u LEFT JOIN latest l ON u.id = l.id GROUP BY u.id""", False)
def record_provider_runs(spark: SparkSession, d: str) -> DataFrame:
    e = driver.read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    summary = F.when(k % 2 == 0, F.parse_json(F.to_json(F.struct(F.struct(k.alias("k")).alias("detail"))))).otherwise(F.parse_json(F.to_json(F.struct(k.alias("odd")))))
    runs = e.select(F.concat(F.lit("user"), F.col("user_id")).alias("id"), F.col("event_type").alias("provider"), ((F.col("event_type") != "error") & (F.col("event_id") % 11 != 0)).alias("ok"), F.col("event_id").alias("at"), summary.alias("summary"))
    assets = runs.select("id").distinct().select("id", F.parse_json(F.lit('{"seen":true}')).alias("record"), F.array().cast("array<string>").alias("sources"))
    out = records.provider_answers(assets, runs)
    return out.select("id", F.array_join("sources", ",").alias("sources"), F.to_json("record").alias("record"))


@query(LINES + """
SELECT key, ord, CAST(json_object('web', json_object('size', CASE WHEN n % 2 = 0 THEN json_object('lines', n) ELSE json_object('lines', NULL) END, 'status', status)) AS VARCHAR) AS chosen,
       CAST(CASE WHEN n = 7 THEN json_object('redirect', 'plain', 'tags', NULL) WHEN n = 5 THEN json_object('redirect', json_object(), 'tags', NULL) WHEN n = 6 THEN json_object('redirect', json_object('code', code), 'tags', NULL)
            ELSE json_object('redirect', NULL, 'tags', CASE WHEN n = 1 THEN to_json([flag, status]) END) END AS VARCHAR) AS rest FROM lines""", False)
def record_projection(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.history import numbered

    seen = _observed(spark, d)
    placed = numbered(seen.withColumn("day", F.to_date("l_shipdate")), ["key"], "day", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "ord")
    pick = lambda **paths: F.to_json(records.project(F.col("record"), **paths))
    return placed.select("key", "ord", pick(include=["web.size.lines", "web.status"]).alias("chosen"), pick(exclude=["web", "redirect.to"]).alias("rest"))


@query(LINES + """
SELECT key, count(*) AS n, count(*) FILTER (n <> 6) AS no_code, count(*) FILTER (n % 2 = 0) AS lines FROM lines GROUP BY key""", False)
def record_gaps(spark: SparkSession, d: str) -> DataFrame:
    at = lambda path, kind="variant": records.value_at(F.col("record"), path, kind)
    return _observed(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(records.absent(F.col("record"), "redirect.code")).alias("no_code"), F.count_if(at("web.size.lines", "int").isNotNull()).alias("lines"))


@query("""SELECT '{"o_orderkey":' || o_orderkey || ',"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","status":' || CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE '"' || o_orderstatus || '"' END
  || ',"price":"' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || '","blob":null}' AS json FROM orders""", False)
def rows_as_json(spark: SparkSession, d: str) -> DataFrame:
    o = driver.read(spark, d, "orders")
    return records.json_safe(o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.col("o_orderpriority").cast("binary").alias("blob")))
