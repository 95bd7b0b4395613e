"""Exact dedup, line dedup, sharding and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, exact_dedup, line_dedup, sharding

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(t):
    return (t or "").translate(FOLD)


@pytest.mark.parametrize("heavy", [2, 64])
def test_exact_groups(docs, documents, monkeypatch, heavy):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", heavy)
    groups = defaultdict(list)
    for i, t, *_ in documents:
        groups[fold(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want


def test_exact_survivors_keep_columns(docs, none):
    out = exact_dedup.drop_exact_duplicates(docs.withColumn("keep_id", F.lit("x")))
    assert out.columns == [*docs.columns, "keep_id"]
    ids = [r.doc_id for r in out.collect()]
    assert {100, 103, 404} <= set(ids) and not {0, 3, 403} & set(ids) and ids.count(407) == 2
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_duplicates(none).count() == 0


def lines_wanted(documents, least=10):
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for _, t, *_ in documents]
    seen = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    return [[x for x in ls if seen[key(x)] < least] for ls in split], [len(ls) for ls in split]


def test_line_dedup(docs, documents, none):
    kept, counts = lines_wanted(documents)
    want = Counter((d[0], n, n - len(k), "\n".join(k)) for d, k, n in zip(documents, kept, counts, strict=True))
    out = line_dedup.line_dedup(docs.withColumn("n_lines", F.lit("clash")))
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == want and any(k[2] for k in want)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_whole_document(spark):
    d = spark.createDataFrame([(i, "Same\nsame ") for i in range(10)], "doc_id long, text string")
    assert {(r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(d).collect()} == {("", 2, 2)}


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards(docs, documents, none, shards):
    got = sharding.shard(docs, shards).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d[0], d[1]) for d in documents)
    by = defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 8 and 0 <= r.shard < shards and r.law == "bytes"
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for i in range(1, shards):  # each boundary is within a row (and the repeated rows, which share a key) of its target
        below = sum(r.size for r in got if r.shard < i)
        assert abs(below - total * i / shards) <= 2 * largest
    assert sharding.shard(none, shards).count() == 0


def test_shards_divide_a_large_group(spark):
    d = spark.createDataFrame([(i, "the same text") for i in range(4000)], "doc_id long, text string")
    sizes = [r["count"] for r in sharding.shard(d, 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * 500 + 2


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = [(1, "n"), (2, None), (3, ""), (4, "ONE"), (None, "zzz qqq"), (5, "never found at all in any text, that is for sure my friend of old")]


def test_decontamination(spark, docs, documents, none):
    passage = documents[-1][1].split()[30:60]
    items = [*BENCH, (12, " ".join(passage).upper() + "!"), (12, " ".join(passage[:11])), (6, "no-id at")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = defaultdict(set)
    for i, t in items:
        ws = WORD.findall(fold(t))
        n = min(len(ws), 10)
        for k in range(len(ws) - n + 1 if n else 0):
            found[tuple(ws[k : k + n])].add("" if i is None else str(i))
    want = Counter()
    for i, t, *_ in documents:
        ws, hit, names = WORD.findall(fold(t)), set(), set()
        for n in {len(w) for w in found}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in found:
                    hit |= set(range(k, k + n))
                    names |= found[tuple(ws[k : k + n])]
        want[i, len(ws), len(hit), tuple(sorted(names)), bool(hit)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.report(docs, bench).collect())
    assert got == want and sum(1 for k in want if k[4]) > 4
    clean = decontaminate.decontaminate(docs, bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[4])
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    for k in want:
        if k[0] is not None:
            assert len(WORD.findall(fold(cut[k[0]]))) == k[1] - k[2]
    assert cut[400] is None and cut[401] == ""
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(documents)
    assert decontaminate.report(none, bench).count() == 0


def test_decontamination_beyond_the_broadcast_limits(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(4, "one"), (7, "no id at all")], "item_id long, text string")
    want = sorted(map(str, decontaminate.report(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontaminate.report(docs, bench).collect())) == want


def test_crc_matches_python(docs):
    r = docs.filter("doc_id = 405").select(F.crc32("text").alias("c"), "text").first()
    assert r.c == zlib.crc32(r.text.encode())


def test_rows_of_one_document_are_one_document_and_any_column_stays(spark):
    rows = [(1, f"shared line\n{i}", "k") for i in range(10)] + [(i, f"common line\nown {i}", "k") for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, __key string").withColumnsRenamed({"__key": "row"})
    out = line_dedup.line_dedup(docs)
    assert {r.n_dropped for r in out.collect() if r.doc_id == 1} == {0} and {r.n_dropped for r in out.collect() if r.doc_id > 1} == {1}
    assert out.columns[:3] == docs.columns and {r["row"] for r in out.collect()} == {"k"}
    bench = spark.createDataFrame([("b", "common line own 21")], "item_id string, text string")
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.decontaminate(docs, bench).count() == 19
