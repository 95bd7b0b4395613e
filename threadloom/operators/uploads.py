"""Matches of uploaded pictures and pages with what is stored."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.correlation import hamming_search

# The kinds of stored pictures in the order that decides between equal similarities.
PICTURES = ("logo", "favicon", "screenshot")


def pictures(assets: DataFrame) -> DataFrame:
    """id, rank, via, h of assets(id, logo, logos, favicon, screenshot; 64-bit hashes, logos an array): each hash that is there."""
    c = F.col
    one = lambda via, h: F.struct(F.lit(PICTURES.index(via)).alias("rank"), F.lit(via).alias("via"), h.alias("h"))
    listed = F.transform(F.coalesce("logos", F.array().cast("array<long>")), lambda h: one("logo", h))
    return assets.select("id", F.explode(F.concat(F.array(*(one(k, c(k).cast("long")) for k in PICTURES)), listed)).alias("p")).select("id", "p.*").filter("h IS NOT NULL")


def nearest_pictures(stored: DataFrame, uploaded: DataFrame, least: float, most: int = 100) -> DataFrame:
    """upload, id, via, similarity, place: of stored(id, rank, via, h), as pictures() gives it, the most alike to each of uploaded(upload, g; a row per hash), least or more.

    An asset counts once for an upload, by its best hash and, of equal ones, the first kind; places go by similarity
    and then id. Every hash is searched. Assets that share a hash are alike to it equally, so only the first most of
    them by id can be among an upload's nearest through it; they are chosen before hashes meet, and each task
    keeps most rows of an upload before the shuffle, so common pictures and uploads stay bounded.
    """
    by_hash = W.partitionBy("h", "rank").orderBy("id")
    few = stored.select("id", "rank", "via", "h").distinct().withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= most).drop("n")
    close = hamming_search(few, uploaded, math.floor(64 * (1 - least) + 1e-9)).join(uploaded.distinct(), "g")
    per_hash = close.groupBy("upload", "h").agg(F.min("bits").alias("bits"))
    met = per_hash.join(few, "h").groupBy("upload", "id").agg(F.min(F.struct("bits", "rank", "via")).alias("b"))
    nearest = W.partitionBy("upload").orderBy("b.bits", "id")
    return met.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= most).select("upload", "id", F.col("b.via").alias("via"), (1 - F.col("b.bits") / 64).alias("similarity"), "place")


def brand_references(brands: DataFrame, wanted: str, most: int = 50) -> DataFrame:
    """id, h: up to most reference logos of a brand, named in any case, from brands(id, brand, reference, h), by id."""
    return brands.filter((F.lower("brand") == wanted.strip().lower()) & F.col("reference")).orderBy("id").limit(most).select("id", "h")


def page_matches(stored: DataFrame, uploaded: DataFrame, least: float = 0.90, most: int = 100) -> DataFrame:
    """upload, id, via, similarity, shared: of stored(id, trackers, title_hash, html) those that uploaded(upload, trackers, title_hash, html) matches.

    A shared tracker goes before an equal title, and that before alike structure (least or more of html's bits).
    shared lists the common trackers in order, empty for other matches. Of each rule an upload has its first most
    assets, by id or for structure by similarity and id, before rules are put together.

    Whoever shares a tracker or a title with an upload and is among its first most, is among the first most that have
    that tracker or title at all; these are chosen before uploads meet them, so common ones stay bounded.
    """
    ids = lambda df, own: df.select(own, F.explode(F.array_distinct(F.coalesce("trackers", F.array().cast("array<string>")))).alias("t")).filter("t <> ''")
    none = F.array().cast("array<string>")
    first = lambda df, *order: df.withColumn("n", F.row_number().over(W.partitionBy("upload").orderBy(*order))).filter(F.col("n") <= most).drop("n")
    least_of = lambda df, c: df.withColumn("n", F.row_number().over(W.partitionBy(c).orderBy("id"))).filter(F.col("n") <= most).drop("n")
    shared = least_of(ids(stored, "id").distinct(), "t").join(ids(uploaded, "upload"), "t").groupBy("upload", "id").agg(F.array_sort(F.collect_set("t")).alias("shared"))
    by_tracker = first(shared, "id").select("upload", "id", F.lit(0).alias("rank"), F.lit("tracking_id").alias("via"), F.lit(1.0).alias("similarity"), "shared")
    named = lambda df, own: df.filter("title_hash IS NOT NULL").select(own, "title_hash")
    by_title = first(least_of(named(stored, "id"), "title_hash").join(named(uploaded, "upload"), "title_hash"), "id").select("upload", "id", F.lit(1).alias("rank"), F.lit("title").alias("via"), F.lit(1.0).alias("similarity"), none.alias("shared"))
    pages = stored.select("id", F.lit(0).alias("rank"), F.lit("structure").alias("via"), F.col("html").alias("h")).filter("h IS NOT NULL")
    alike = nearest_pictures(pages, uploaded.select("upload", F.col("html").alias("g")), least, most)
    by_html = alike.select("upload", "id", F.lit(2).alias("rank"), "via", "similarity", none.alias("shared"))
    every = by_tracker.unionByName(by_title).unionByName(by_html)
    return every.groupBy("upload", "id").agg(F.min_by(F.struct("via", "similarity", "shared"), "rank").alias("m")).select("upload", "id", "m.*")
