"""Streaming forms of the run history: daily counts, failure state, session windows, a cache with expiry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The setting that streams with state of their own need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def daily(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """provider, day, calls, errors by event time; runs(ts, provider, ok). Rows later than delay are dropped."""
    timed = runs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy(F.window("ts", "1 day").alias("w"), "provider").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"))
    return out.select("provider", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "calls", "errors")


def sessions(runs: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """username, start, calls: runs of a user without a pause of gap. An addition; the domain itself has no sessions."""
    timed = runs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "username").agg(F.count(F.lit(1)).alias("calls"))
    return out.select("username", F.col("w.start").alias("start"), "calls")


class _Failures(StatefulProcessor):
    """Keeps how many runs of a key have failed since its last success."""

    def __init__(self, key: str, down_at: int):
        self.key, self.down_at = key, down_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("failures", "failures int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names of the interface)
        """Failures after the batch's last success count on, without sorting or holding whole rows."""
        good, bad = None, []
        for r in rows:
            at = (r.ts, r.event_id)
            if not r.ok:
                bad.append(at)
            elif good is None or at > good:
                good = at
        before = self.count.get()[0] if good is None and self.count.exists() else 0
        failures = before + sum(good is None or at > good for at in bad)
        self.count.update((failures,))
        yield Row(**{self.key: key[0], "failures": failures, "health": "down" if failures >= self.down_at else "degraded" if failures else "healthy"})


def failure_state(runs: DataFrame, key: str = "provider", down_at: int = 5) -> DataFrame:
    """key, failures, health after each batch that has runs of the key; runs(key, ts, event_id, ok).

    The count of consecutive failures is kept as state, which needs the RocksDB state store (STATE_STORE).
    """
    return runs.select(key, "ts", "event_id", "ok").groupBy(key).transformWithState(_Failures(key, down_at), f"{key} string, failures int, health string", "Update", "None")


class _Cache(StatefulProcessor):
    """The entry of a cache key until it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, put_at long, expires_at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.entry.get()) if self.entry.exists() else None
        before = held
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if r.op == "put":
                held = (r.value, r.at, r.expires_at)
            elif r.op == "purge":
                held = None
            else:
                hit = held is not None and held[2] > r.at
                yield Row(provider=key[0], key=key[1], seq=r.seq, at=r.at, outcome="hit" if hit else "miss", value=held[0] if hit else None)
        if held == before:
            return
        if before is not None:
            self.handle.deleteTimer(before[2] * 1000)
        if held is None:
            self.entry.clear()
        else:
            self.entry.update(held)
            self.handle.registerTimer(held[2] * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """The watermark has passed the entry's end: it goes, and a row says so."""
        if self.entry.exists():
            value, _, expires_at = self.entry.get()
            self.entry.clear()
            yield Row(provider=key[0], key=key[1], seq=None, at=expires_at, outcome="expired", value=value)


def ttl_cache(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """provider, key, seq, at, outcome, value: each get of a stream of cache events as hit or miss, and entries as they expire.

    events has ts (event time), at (the same as epoch seconds), seq (tells events of one second apart), provider, key,
    op (put, get or purge), value and expires_at. A get sees the latest put before it unless that was purged or has
    expired. An entry is state until the watermark, delay behind the latest event, passes its end; then it is dropped
    and told as expired. Events later than delay are dropped. Needs the RocksDB state store (STATE_STORE).
    """
    timed = events.withWatermark("ts", delay)
    out = "provider string, key string, seq long, at long, outcome string, value string"
    return timed.groupBy("provider", "key").transformWithState(_Cache(), out, "Append", "EventTime")


def cache_outcomes(events: DataFrame) -> DataFrame:
    """provider, key, seq, at, outcome, value of each get in the same events as a table: the batch form of ttl_cache()."""
    w = W.partitionBy("provider", "key").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, -1)
    told = F.last(F.when(F.col("op") != "get", F.struct("op", "value", "expires_at")), ignorenulls=True).over(w)
    gets = events.withColumn("last", told).filter("op = 'get'")
    hit = F.coalesce((F.col("last.op") == "put") & (F.col("last.expires_at") > F.col("at")), F.lit(False))
    return gets.select("provider", "key", "seq", "at", F.when(hit, "hit").otherwise("miss").alias("outcome"), F.when(hit, F.col("last.value")).alias("value"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is there into Parquet at path; with the checkpoint a restart goes on where it was."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
