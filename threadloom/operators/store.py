"""Merge writers: upserts of assets and edges, cascade delete, links, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import csv_cell


def _union(c: str):
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)


def upsert_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per id of assets old and new: the newest value that is not null, the earliest first_seen, the latest last_seen, arrays united.

    Both have the columns id, type, value, status, confidence, impersonation_score, is_root,
    investigation_ids, sources, first_seen and last_seen. Of equal last_seen, new wins.
    """
    both = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("last_seen", "__g"))).alias(c)
    return both.groupBy("id").agg(*(latest(c) for c in ("type", "value", "status", "confidence", "impersonation_score")), F.max("is_root").alias("is_root"),
        _union("investigation_ids"), _union("sources"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def upsert_edges(edges: DataFrame, keep: int = 20) -> DataFrame:
    """One row per id of edges(id, source, type, target, at, evidence): loops rejected, the last keep evidence entries by time, oldest first.

    Entries beyond keep are cut by a window before they are gathered, so a busy edge stays bounded.
    """
    from threadloom.operators.history import newest

    kept = newest(edges.filter("source <> target"), ["id"], "at", keep, "evidence")
    seen = edges.filter("source <> target").groupBy("id").agg(F.first("source").alias("source"), F.first("type").alias("type"), F.first("target").alias("target"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    listed = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence"))), lambda e: e["evidence"]).alias("evidence"))
    return seen.join(listed, "id")


def without_investigation(df: DataFrame, investigation: str) -> DataFrame:
    """df with the id pulled from investigation_ids."""
    return df.withColumn("investigation_ids", F.array_remove("investigation_ids", investigation))


def linked(df: DataFrame, column: str, add: list[str], remove: list[str]) -> DataFrame:
    """df with values put into and taken from a set column."""
    return df.withColumn(column, F.array_sort(F.array_except(F.array_union(F.coalesce(column, F.array().cast("array<string>")), F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>"))))


def csv_rows(df: DataFrame) -> DataFrame:
    """df as text cells that no spreadsheet takes for formulas; arrays joined by a space."""
    return df.select(*(csv_cell(F.array_join(c, " ") if t.startswith("array") else F.col(c).cast("string")).alias(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.option("header", True).csv(path)


def expand_facts(runs: DataFrame, most: int = 300) -> DataFrame:
    """origin, relation, type, value, source, target, provider: the first most related entities of each run, as edges in their direction.

    runs has origin, provider and related, an array of structs (type, value, relation, reverse).
    """
    each = runs.select("origin", "provider", F.posexplode("related").alias("pos", "r")).filter(F.col("pos") < most).select("origin", "provider", "r.*").filter("value IS NOT NULL AND value <> ''")
    node = F.substring(F.sha2(F.concat_ws("|", "type", "value"), 256), 1, 24)
    out = each.withColumn("node", node)
    return out.select("origin", "provider", "relation", "type", "value", F.when(F.col("reverse"), F.col("node")).otherwise(F.col("origin")).alias("source"), F.when(F.col("reverse"), F.col("origin")).otherwise(F.col("node")).alias("target"))
