"""Nested records against plain dictionaries."""

import json
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from threadloom.operators import records


def merged(old, new, depth):
    """new onto old: the rule, one update at a time."""
    if not isinstance(new, dict) or depth == 0:
        return new
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in new.items():
        if v is not None:
            out[k] = merged(out.get(k), v, depth - 1)
    return out


def made(rng, depth):
    """A document of few names, so that updates meet, contradict each other and hold nulls, arrays and empty objects."""
    out = {}
    for k in rng.sample(['a', 'b', 'é"q', "a.b", ""], rng.randint(0, 4)):
        kind = rng.randint(0, 6)
        out[k] = made(rng, depth - 1) if kind < 3 and depth else rng.choice([None, 1, "x{", True, [1, None, {"z": 1}], "", -2.5, {}])
    return out


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_merge(spark, depth):
    rng = random.Random(depth)
    rows, want = [], {}
    for key in [*range(60), None]:
        want[key] = {}
        for at in range(rng.randint(1, 6)):
            doc = made(rng, 3)
            rows.append((key, at, json.dumps(doc)))
            want[key] = merged(want[key], doc, depth)
    rows += [(100, 1, None), (101, 1, "[1]"), (101, 2, '"x"'), (102, 1, "{}")]
    want |= {100: {}, 101: {}, 102: {}}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, at int, t string").repartition(4).select("key", "at", F.parse_json("t").alias("doc"))
    got = {r.key: json.loads(r.t) for r in records.merge(df, ["key"], "doc", ["at"], depth).select("key", F.to_json("doc").alias("t")).collect()}
    assert got == want
    assert records.merge(df.limit(0), ["key"], "doc", ["at"]).count() == 0


def test_upsert_keeps_inserts_and_overrides(spark):
    old = spark.createDataFrame([(1, '{"web":{"title":"old","n":1},"tags":["a"],"gone":5}'), (2, '{"x":1}')], "id int, t string").select("id", F.parse_json("t").alias("doc"))
    new = spark.createDataFrame([(1, 7, '{"web":{"title":null,"n":2},"tags":["b","c"],"gone":{"y":1}}'), (3, 1, '{"z":null}')], "id int, at int, t string").select("id", "at", F.parse_json("t").alias("doc"))
    got = {r.id: json.loads(r.t) for r in records.upsert(old, new, ["id"], "doc", ["at"]).select("id", F.to_json("doc").alias("t")).collect()}
    assert got == {1: {"web": {"title": "old", "n": 2}, "tags": ["b", "c"], "gone": {"y": 1}}, 2: {"x": 1}, 3: {}}


def projected(doc, paths, keep):
    def walk(v, under):
        if not isinstance(v, dict):
            return v
        out = {}
        for k, x in v.items():
            path = (*under, k)
            whole, inner = path in paths, any(p[: len(path)] == path and len(p) > len(path) for p in paths)
            if keep and whole or not keep and not whole and not inner:
                out[k] = x
            elif inner and not whole:
                if isinstance(x, dict):
                    out[k] = walk(x, path)
                elif not keep:
                    out[k] = x
        return out

    return walk(doc, ())


def test_project_and_absent(spark):
    docs = [{"a": {"b": {"c": 1, "d": 2}, "e": [1]}, "f": None}, {"a": 5, "f": 1}, {"a": {"e": 2}}, {}, {"a": {"b": 3}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").select("i", F.parse_json("t").alias("doc"))
    for paths in (["a.b.c", "f"], ["a.b", "a.b.c"], ["a"], ["a.e", "x.y"]):
        keys = {tuple(p.split(".")) for p in paths}
        got = df.select("i", F.to_json(records.project(F.col("doc"), include=paths)).alias("i_"), F.to_json(records.project(F.col("doc"), exclude=paths)).alias("e_")).collect()
        for r in got:
            assert json.loads(r.i_) == projected(docs[r.i], keys, True) and json.loads(r.e_) == projected(docs[r.i], keys, False), (paths, docs[r.i])
    assert {r.i for r in df.filter(records.absent(F.col("doc"), "f")).collect()} == {2, 3, 4}
    assert {r.i for r in df.filter(records.absent(F.col("doc"), "a.b")).collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        records.project(F.col("doc"), ["a"], ["b"])


def test_later_wins_and_json_safe(spark):
    df = spark.range(1).select(F.parse_json(F.lit('{"a":1,"b":{"c":1}}')).alias("x"), F.parse_json(F.lit('{"b":null,"d":[2]}')).alias("y"))
    assert json.loads(df.select(F.to_json(records.later_wins(F.col("x"), F.col("y")))).first()[0]) == {"a": 1, "b": None, "d": [2]}
    row = (datetime(2024, 1, 2, 3, 4, 5), b"raw", Decimal("1.50"), None, [1, 2])
    safe = spark.createDataFrame([row], "at timestamp, blob binary, price decimal(5,2), none string, list array<int>")
    assert json.loads(records.json_safe(safe).first()[0]) == {"at": "2024-01-02T03:04:05.000000Z", "blob": None, "price": "1.50", "none": None, "list": [1, 2]}


def test_provider_answers(spark):
    assets = spark.createDataFrame([("a", '{"enrichment":{"w":{"old":1,"_fetched_at":0},"r":{"k":1}},"x":1}', ["seed"]), ("b", "{}", None)], "id string, t string, sources array<string>").select("id", F.parse_json("t").alias("record"), "sources")
    runs = [("a", "w", True, 5, '{"n":1}'), ("a", "w", True, 9, '{"m":{"q":2}}'), ("a", "w", False, 99, '{"bad":1}'), ("b", "v", True, 3, None), ("zz", "w", True, 3, "{}"), (None, "w", True, 3, "{}")]
    given = spark.createDataFrame(runs, "id string, provider string, ok boolean, at long, t string").select("id", "provider", "ok", "at", F.parse_json("t").alias("summary"))
    got = {r.id: (json.loads(r.t), r.sources) for r in records.provider_answers(assets, given).select("id", F.to_json("record").alias("t"), "sources").collect()}
    assert got == {"a": ({"enrichment": {"w": {"m": {"q": 2}, "_fetched_at": 9}, "r": {"k": 1}}, "x": 1}, ["seed", "w"]), "b": ({"enrichment": {"v": {"_fetched_at": 3}}}, ["v"])}
