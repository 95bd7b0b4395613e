"""Ordered-group operators over runs and events: caps, streaks, limits, throttles, running bests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: str, n: int, tie: str) -> DataFrame:
    """The last n rows of each key by order."""
    w = W.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def streaks(runs: DataFrame, key: str = "username", down_at: int = 5) -> DataFrame:
    """runs with failures (consecutive, up to here) and health: down from down_at on, degraded below, healthy without."""
    w = W.partitionBy(key).orderBy("moment", "event_id")
    island = runs.withColumn("__i", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    count = F.sum((~F.col("ok")).cast("int")).over(W.partitionBy(key, "__i").orderBy("moment", "event_id").rowsBetween(W.unboundedPreceding, 0))
    out = island.withColumn("failures", count).drop("__i")
    return out.withColumn("health", F.when(F.col("failures") >= down_at, "down").when(F.col("failures") > 0, "degraded").otherwise("healthy"))


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "number") -> DataFrame:
    """df with the place of each row within keys, from 1, by bucket (null first) and then order.

    Rows are ranked within their bucket, and the sizes of earlier buckets added, so a key with many rows is
    shared by as many tasks as it has buckets.
    """
    each = [F.col(k) for k in (*keys, bucket)]
    sizes = df.groupBy(*each).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(k).alias(f"__{k}") for k in (*keys, bucket)), before.alias("__before"))
    placed = df.withColumn("__place", F.row_number().over(W.partitionBy(*each).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, bucket)])
    return placed.join(starts, same).withColumn(name, F.col("__place") + F.col("__before")).drop("__place", "__before", *(f"__{k}" for k in (*keys, bucket)))


def within_daily_limit(runs: DataFrame, limit: int, key: str = "provider") -> DataFrame:
    """runs with allowed: whether fewer than limit calls of the key came before on that day."""
    hourly = runs.withColumn("__hour", F.floor(F.col("moment") / 3600))
    out = numbered(hourly, [key, "day"], "__hour", ["moment", "event_id"], "__n")
    return out.withColumn("allowed", F.col("__n") <= limit).drop("__n", "__hour")


def throttled(runs: DataFrame, failures: int = 10, seconds: int = 900, key: str = "username") -> DataFrame:
    """runs with recent (failures of the key in the trailing seconds and since its last success, this one included) and locked (as many as failures or more).

    A success clears the count.
    """
    w = W.partitionBy(key).orderBy("moment", "event_id")
    island = runs.withColumn("__i", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    recent = W.partitionBy(key, "__i").orderBy("moment").rangeBetween(-seconds, 0)
    out = island.withColumn("recent", F.coalesce(F.sum((~F.col("ok")).cast("int")).over(recent), F.lit(0))).drop("__i")
    return out.withColumn("locked", F.col("recent") >= failures)


def stage_states(events: DataFrame) -> DataFrame:
    """investigation, stage, status, progress, runs: of events(investigation, stage, moment, event_id, status, progress) the latest state of each stage.

    progress lies between 0 and 100, and is 100 where the stage is completed or skipped.
    """
    last = F.max_by(F.struct("status", "progress"), F.struct("moment", "event_id"))
    out = events.groupBy("investigation", "stage").agg(last.alias("s"), F.count(F.lit(1)).alias("runs"))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("s.progress", F.lit(0))))
    return out.select("investigation", "stage", "s.status", F.when(F.col("s.status").isin("completed", "skipped"), 100).otherwise(clamped).alias("progress"), "runs")


def overall_status(states: DataFrame, required: str = "collection") -> DataFrame:
    """investigation, status, progress (rounded mean): failed if the required stage failed, running if any stage runs or waits, completed otherwise, whatever else failed."""
    failed = F.bool_or((F.col("stage") == required) & (F.col("status") == "failed"))
    open_ = F.bool_or(F.col("status").isin("pending", "running"))
    return states.groupBy("investigation").agg(F.when(failed, "failed").when(open_, "running").otherwise("completed").alias("status"), F.floor(F.avg("progress") + 0.5).cast("int").alias("progress"))


def unexpired(cache: DataFrame, now: int) -> DataFrame:
    """The newest entry of each key of cache(provider, key, put_at, expires_at, value) that has not expired at now."""
    best = F.max_by(F.struct("put_at", "expires_at", "value"), F.struct("put_at", "value"))
    return cache.filter(F.col("expires_at") > now).groupBy("provider", "key").agg(best.alias("b")).select("provider", "key", "b.*")


def hops(steps: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, previous, value: each step with the one before it; the first of a key has none."""
    w = W.partitionBy(key).orderBy(order)
    return steps.select(key, order, F.lag(value).over(w).alias("previous"), value)


def running_best(scores: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """scores with best: the greatest so far of each key."""
    w = W.partitionBy(key).orderBy(order, "event_id").rowsBetween(W.unboundedPreceding, 0)
    return scores.withColumn("best", F.max(score).over(w))


def dense_days(counts: DataFrame, first: str, days: int) -> DataFrame:
    """day, and the measures of counts(day, ...) with 0 for days that it lacks."""
    every = counts.sparkSession.range(days).select(F.date_format(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    out = every.join(counts, "day", "left")
    return out.fillna(0)
