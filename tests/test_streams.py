"""State with expiry, restarts and idempotent sinks; artifacts and spans."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from threadloom.operators import artifacts
from threadloom.streaming import events, sinks

CACHE = "ts timestamp, at long, seq long, provider string, key string, op string, value string, expires_at long"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*events.STATE_STORE)
    yield spark
    spark.conf.unset(events.STATE_STORE[0])


def cache_rows(rng, first, n, seq):
    out = []
    for i in range(n):
        at = first + rng.randint(0, 500)
        op = rng.choice(["put", "get", "get", "get", "purge"]) if rng.random() < 0.9 else "put"
        ttl = rng.choice([1, 60, 400, 5000])
        out.append((datetime.fromtimestamp(at, UTC).replace(tzinfo=None), at, seq + i, rng.choice("pq"), rng.choice("abc"), op, f"v{seq + i}" if op == "put" else None, at + ttl if op == "put" else None))
    return out


def test_ttl_cache_restarts_and_agrees_with_the_batch_form(rocks, tmp_path):
    rng, rows = random.Random(1), []
    started = 1_700_000_000

    def drain(batches):
        for k, b in batches:
            rocks.createDataFrame(b, CACHE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = rocks.readStream.schema(CACHE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        events.run_once(events.ttl_cache(stream, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    for part in range(2):  # the second part goes on from the checkpoint of the first
        made = [(2 * part + k, cache_rows(rng, started + 501 * (2 * part + k), 60, 1000 * (2 * part + k))) for k in range(2)]
        rows += [r for _, b in made for r in b]
        drain(made)
    drain([(9, [(datetime.fromtimestamp(started + 90_000, UTC).replace(tzinfo=None), started + 90_000, 9999, "p", "zz", "get", None, None)]), (10, [(datetime.fromtimestamp(started + 90_001, UTC).replace(tzinfo=None), started + 90_001, 10000, "p", "zz", "get", None, None)])])
    got = rocks.read.parquet(f"{tmp_path}/out")
    told = {tuple(r) for r in got.filter("outcome <> 'expired' AND key <> 'zz'").collect()}
    want = {tuple(r) for r in events.cache_outcomes(rocks.createDataFrame(rows, CACHE)).collect()}
    assert told == want and {r[4] for r in want} == {"hit", "miss"}
    last = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if r[5] != "get":
            last[r[3], r[4]] = (r[6], r[7]) if r[5] == "put" else None
    gone = {(r.provider, r.key, r.value, r.at) for r in got.filter("outcome = 'expired'").collect()}
    assert {(*k, *v) for k, v in last.items() if v} <= gone  # what was left at the end has expired


def test_failure_state_over_batches(rocks, tmp_path):
    kinds = "provider string, ts timestamp, event_id long, ok boolean"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    batches = [[("p", at(2), 2, False), ("p", at(1), 1, True), ("p", at(1), 3, False), ("q", at(1), 4, False)], [("p", at(5), 5, False), ("q", at(9), 6, True), ("q", at(3), 7, False)]]
    for k, want in enumerate([{("p", 2, "degraded"), ("q", 1, "degraded")}, {("p", 3, "down"), ("q", 0, "healthy")}]):
        rocks.createDataFrame(batches[k], kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream, got = rocks.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), []
        each = events.failure_state(stream, down_at=3).writeStream.outputMode("update").foreachBatch(lambda df, _, got=got: got.extend(map(tuple, df.collect())))
        each.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        assert set(got) == want


ITEMS = "kind string, investigation_id string, asset_id string, content_type string, content string, created_at timestamp"


def test_batches_replayed_leave_one_copy(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    item = lambda n, day=1: ("page", f"inv{n % 2}", None, "text/html", f"<p>{n}</p>", at.replace(day=day))
    make = lambda rows: artifacts.stored(spark.createDataFrame(rows, ITEMS))
    path = f"{tmp_path}/table"
    batches = [make([item(1), item(1), item(2)]), make([item(2), item(3), item(3, 2)]), make([item(1), item(4, 3)])]
    for n, b in [(0, 0), (0, 0), (1, 1), (1, 1), (0, 0), (2, 2), (2, 2)]:
        sinks.write_batch(batches[b], n, path)
    got = spark.read.parquet(path)
    assert sorted((r.content, str(r.day)) for r in got.collect()) == [("<p>1</p>", "2024-01-01"), ("<p>2</p>", "2024-01-01"), ("<p>3</p>", "2024-01-01"), ("<p>3</p>", "2024-01-02"), ("<p>4</p>", "2024-01-03")]
    assert got.select("id").distinct().count() == 5


def test_append_once_from_a_stream(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    for k in range(2):
        spark.createDataFrame([("page", "i", None, "text/html", f"{n}", at) for n in range(k, k + 3)], ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = artifacts.stored(spark.readStream.schema(ITEMS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        sinks.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted(r.content for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["0", "1", "2", "3"]


def test_audit_never_raises(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "u", "login", None), (datetime(2024, 1, 2), "v", "logout", "failure")], "timestamp timestamp, username string, action string, status string")
    assert sinks.append_audit(rows, f"{tmp_path}/audit")
    got = {(r.username, r.status, r.details, str(r.day)) for r in spark.read.parquet(f"{tmp_path}/audit").collect()}
    assert got == {("u", "success", "{}", "2024-01-01"), ("v", "failure", "{}", "2024-01-02")}
    assert not sinks.append_audit(rows.select("username"), f"{tmp_path}/audit") and not sinks.append_audit(rows, "nosuchscheme://x/y")


def test_listing_notes_and_screenshots(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("page", "i1", "a1", "t", "one", at(3)), ("provider:scan", "i1", "a1", "t", "secret", at(1)), ("screenshot", "i1", "a2", "t", None, at(2)), ("page", "i2", "a1", "t", "two", at(4))]
    table = artifacts.stored(spark.createDataFrame(rows, ITEMS))
    assert [(r.kind, r.content) for r in artifacts.listed(table, investigation="i1").collect()] == [("provider:scan", None), ("screenshot", None), ("page", "one")]
    assert [r.content for r in artifacts.listed(table, asset="a1", kind="page").collect()] == ["two", "one"] and artifacts.listed(table, asset="a1", most=1).count() == 1
    with pytest.raises(ValueError):
        artifacts.listed(table)
    shot = artifacts.recent_screenshots(table, spark.createDataFrame([("a1", "x.com", "ACTIVE")], "id string, value string, status string")).collect()
    assert [(r.asset_id, r.value) for r in shot] == [("a2", None)]
    row = table.filter("content = 'one'").first()
    assert (row["size"], len(row.sha256), len(row.id)) == (3, 64, 32) and table.filter("kind = 'screenshot'").first().sha256 is None
    notes = spark.createDataFrame([("a", 2, "u", " later "), ("a", 1, "v", "first"), ("a", 3, "u", "  "), ("z", 1, "u", "x")], "id string, at int, author string, text string")
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {r.id: [n.text for n in r.notes] for r in artifacts.noted(df, notes).collect()}
    assert got == {"a": ["first", "later"], "b": []}
    assert [n.text for n in artifacts.noted(artifacts.noted(df, notes), notes).filter("id = 'a'").first().notes] == ["first", "later"] * 2


def test_history(spark):
    kinds = "id string, recent_snapshots array<struct<timestamp:string,archive_url:string,screenshot_url:string,status:int>>, historical_screenshots array<struct<time:string,url:string,screenshot:string>>"
    snaps = [(f"2024-01-{d:02}", f"w{d}", None, 200) for d in range(1, 30)]
    seeds = spark.createDataFrame([("a", snaps, [("2024-01-05", "u5", "s"), (None, "u0", None), ("2025", "u9", "s")]), ("b", None, None)], kinds)
    got = [(r.source, r.url) for r in artifacts.history(seeds).orderBy("place").collect()]
    assert len(got) == 27 and got[0] == ("urlscan", "u9") and got[1] == ("wayback", "w24") and got[-1] == ("urlscan", "u0") and got.index(("wayback", "w5")) + 1 == got.index(("urlscan", "u5"))


def test_stage_log_and_spans(spark):
    stages = spark.createDataFrame([("i", "pivot", [(2, "info", "b"), (1, "info", "a")]), ("i", "dns", [(3, "warning", "c")])], "investigation string, stage string, events array<struct<ts:int,level:string,message:string>>")
    assert [r.message for r in artifacts.stage_log(stages).orderBy(F.desc("ts")).collect()] == ["c", "b", "a"]
    rng = random.Random(2)
    rows = [(rng.choice(["h", "g", None]), rng.choice([None, *range(0, 4000)])) for _ in range(300)]
    want = set()
    for host in {r[0] for r in rows}:
        times, run = sorted(t for h, t in rows if h == host and t is not None), []
        for t in times:
            if run and t - run[-1] > 30:
                want.add((host, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.add((host, run[0], run[-1], len(run)))
    assert {tuple(r) for r in artifacts.spans(spark.createDataFrame(rows, "host string, at int"), ["host"], "at", 30).collect()} == want
