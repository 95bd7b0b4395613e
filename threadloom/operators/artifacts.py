"""Stored artifacts: JSON and files with their digests, listings, notes, screenshots and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(items: DataFrame) -> DataFrame:
    """items(kind, investigation_id, asset_id, content_type, content (binary or text), created_at, ...) with id, size, sha256 and day.

    The id is a digest of what, for whom and when, so the same item met twice has the same id. A null content has no size and digest.
    """
    content = F.col("content").cast("binary")
    digest = F.sha2(content, 256)
    told = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("kind", "investigation_id", "asset_id", "created_at")), F.coalesce(digest, F.lit("-")))
    return items.withColumn("id", F.substring(F.sha2(told, 256), 1, 32)).withColumn("size", F.octet_length(content).cast("long")).withColumn("sha256", digest).withColumn("day", F.to_date("created_at"))


def listed(artifacts: DataFrame, investigation: str | None = None, asset: str | None = None, kind: str | None = None, most: int = 500) -> DataFrame:
    """The artifacts of an investigation, oldest first, or of an asset, newest first, of one kind if given, at most so many; ids break ties.

    Exactly one of investigation and asset is given. What providers sent is not shown: content is null where the kind starts with provider:.
    """
    if (investigation is None) == (asset is None):
        raise ValueError("give an investigation or an asset")
    out = artifacts.filter(F.col("investigation_id") == investigation) if investigation is not None else artifacts.filter(F.col("asset_id") == asset)
    out = out.filter(F.col("kind") == kind) if kind else out
    ordered = out.orderBy(F.asc("created_at") if investigation is not None else F.desc("created_at"), "id").limit(most)
    return ordered.withColumn("content", F.when(~F.col("kind").startswith("provider:"), F.col("content")))


def recent_screenshots(artifacts: DataFrame, assets: DataFrame, most: int = 12) -> DataFrame:
    """id, asset_id, created_at, value, status: the newest screenshots with their assets, if those are still there."""
    newest = artifacts.filter("kind = 'screenshot'").orderBy(F.desc("created_at"), "id").limit(most).select("id", "asset_id", "created_at")
    return newest.join(assets.select(F.col("id").alias("asset_id"), "value", "status"), "asset_id", "left")


def noted(df: DataFrame, notes: DataFrame, key: str = "id") -> DataFrame:
    """df with notes(key, at, author, text) put behind its column notes, in order of time; blank texts are left out."""
    fine = notes.filter(F.trim("text") != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "author", F.trim("text").alias("text")))).alias("__new"))
    kind = dict(fine.dtypes)["__new"]
    none = F.array().cast(kind)
    have = F.coalesce("notes", none) if "notes" in df.columns else none
    return df.join(fine, key, "left").withColumn("notes", F.concat(have, F.coalesce("__new", none))).drop("__new")


def history(seeds: DataFrame, snapshots: int = 24, shots: int = 30) -> DataFrame:
    """id, place, source, time, url, screenshot_url, status: the timeline of each of seeds(id, recent_snapshots, historical_screenshots), newest first.

    The first 24 archive snapshots and the first 30 scans count; entries without a time come last. Of equal times the
    archive goes first, and then the order in the lists.
    """
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    archive = F.transform(F.slice("recent_snapshots", 1, snapshots), lambda s, i: F.struct(F.lit("wayback").alias("source"), text(s["timestamp"]).alias("time"), s["archive_url"].alias("url"), s["screenshot_url"].alias("screenshot_url"), text(s["status"]).alias("status"), i.alias("n")))
    scans = F.transform(F.slice("historical_screenshots", 1, shots), lambda s, i: F.struct(F.lit("urlscan").alias("source"), text(s["time"]).alias("time"), s["url"].alias("url"), s["screenshot"].alias("screenshot_url"), none.alias("status"), (i + snapshots).alias("n")))
    empty = F.array().cast("array<struct<source:string,time:string,url:string,screenshot_url:string,status:string,n:int>>")
    both = F.concat(F.coalesce(archive, empty), F.coalesce(scans, empty))
    later = lambda a, b: F.when(F.coalesce(a["time"], F.lit("")) > F.coalesce(b["time"], F.lit("")), -1).when(F.coalesce(a["time"], F.lit("")) < F.coalesce(b["time"], F.lit("")), 1).otherwise(a["n"] - b["n"])
    each = seeds.select("id", F.posexplode(F.array_sort(both, later)).alias("place", "e"))
    return each.select("id", "place", "e.source", "e.time", "e.url", "e.screenshot_url", "e.status")


def stage_log(stages: DataFrame) -> DataFrame:
    """investigation, stage, ts, level, message: the events of stages(investigation, stage, events: an array of (ts, level, message)) of all stages together, to be ordered by ts."""
    return stages.select("investigation", "stage", F.explode("events").alias("e")).select("investigation", "stage", "e.*")


def spans(observed: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """keys, start, stop, n: maximal runs of observations of keys whose times (in seconds) follow each other within gap.

    Times are bucketed by gap first: a bucket's observations are summed before they are shuffled by key, and any
    two in one bucket, or in neighbouring ones within gap, belong together. So a host seen a thousand times a day
    costs a row per bucket. A null time is left out.
    """
    from pyspark.sql import Window as W

    cells = observed.filter(F.col(at).isNotNull()).withColumn("__cell", F.floor(F.col(at) / max(gap, 1)))
    cells = cells.groupBy(*keys, "__cell").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys).orderBy("__cell")
    begun = cells.withColumn("__new", F.coalesce((F.col("lo") - F.lag("hi").over(w) > gap).cast("int"), F.lit(1)))
    runs = begun.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min("lo").alias("start"), F.max("hi").alias("stop"), F.sum("n").alias("n")).drop("__run")
