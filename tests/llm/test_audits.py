"""Merkle manifest, token counts and filter audit against brute force and the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import filter_audit, merkle, token_counts

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def encoded(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """The root of nodes, and the (before, after) steps of each of them."""
    steps, levels = [[] for _ in nodes], [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    for k, below in enumerate(levels[:-1]):
        for i in range(len(nodes)):
            j = i // 8**k
            lo = j // 8 * 8
            steps[i].append(("".join(below[lo:j]), "".join(below[j + 1 : lo + 8])))
    return levels[-1][0], steps


def manifest_wanted(rows):
    """Multiset of (group, order, leaf, subroot, root, steps) for rows (group, order, leaf)."""
    by = defaultdict(list)
    for g, i, x in rows:
        by[g].append((i is not None, i or 0, x))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: (sorted(by[g]), *tree([x for *_, x in sorted(by[g])])) for g in groups}
    root, above = tree([done[g][1] for g in groups])
    return Counter((g, i if has else None, x, done[g][1], root, tuple(p + up)) for g, up in zip(groups, above, strict=True) for (has, i, x), p in zip(done[g][0], done[g][2], strict=True))


def manifest_got(rows):
    return Counter((r.lang, r.doc_id, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.proof)) for r in rows)


def test_manifest_of_documents(docs, documents, none):
    want = manifest_wanted([(lang, i, encoded(i, source, lang, n, t)) for i, t, lang, source, n in documents])
    given = docs.select("doc_id", "lang", merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"), F.lit(1).alias("proof"), F.lit("x").alias("G"), F.lit(2).alias("at_"), F.lit(3).alias("block"))
    out = merkle.manifest(given)
    assert set(out.columns) == {"doc_id", "lang", "leaf", "G", "at_", "block", "root", "subroot", "proof"}
    rows = out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("wrong", merkle.fold(F.lit("0" * 64), F.col("proof"))).collect()
    assert manifest_got(rows) == want and all(r.folded == r.root != r.wrong and r.G == "x" and r.block == 3 for r in rows)
    assert merkle.manifest(none.select("doc_id", "lang", F.lit("").alias("leaf"))).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, None: 1}, {"a": 513, "": 512, None: 9}, {"de": 4100, "en": 64, "é": 8, "z": 65}, {f"g{i:03}": 1 + i % 3 for i in range(600)}])
def test_manifest_at_edges_of_blocks(spark, sizes):
    rows = [(g, i, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    given = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(5)
    assert manifest_got(merkle.manifest(given).collect()) == manifest_wanted(rows)


def test_manifest_query(spark, docs, documents, tmp_path):
    from threadloom.llm.queries import op11_merkle_manifest

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = manifest_wanted([(lang, i, encoded(i, source, lang, n, t)) for i, t, lang, source, n in documents])
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == Counter((i, x, sub, root, sha("".join(a + b for a, b in steps))) for _, i, x, sub, root, steps in want.elements())
    texts = {(i, encoded(i, source, lang, n, t)): t for i, t, lang, source, n in documents}
    for r in got:
        t = texts[r.doc_id, r.leaf]
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and t is not None and t.translate(FOLD) != t
        assert r.verified == (not changed) == (r.folded_root == r.root)
    assert {r.verified for r in got} == {True, False}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer())


def counts(library, texts):
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(docs, documents, none, library):
    out = token_counts.token_counts(docs.withColumn("n_tokens", F.lit("clash")).withColumn("known", F.lit(1)), limit=100)
    want = Counter((d[0], len((d[1] or "").encode()), n, n > 100) for d, n in zip(documents, counts(library, [d[1] for d in documents]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "known", "n_bytes", "n_tokens", "over_limit"}
    assert token_counts.token_counts(none).count() == 0


def test_token_counts_query(spark, docs, documents, library, tmp_path):
    from threadloom.llm.queries import op12_token_counts

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((d[0], len((d[1] or "").encode()), n, n > 1024) for d, n in zip(documents, counts(library, [d[1] for d in documents]), strict=True))
    assert Counter(map(tuple, op12_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


@pytest.mark.parametrize("block,merged", [(64, 32), (1 << 20, 1 << 18)])
def test_token_counts_of_odd_texts(library, monkeypatch, block, merged):
    """White space of all kinds, contractions, numerals, letters that Python does not know, added tokens, long runs."""
    monkeypatch.setattr(token_counts, "BLOCK", block)
    monkeypatch.setattr(token_counts, "MERGED", merged)
    monkeypatch.setattr(token_counts, "KNOWN", 50)
    rng = random.Random(3)
    signs = " \n\t\r\x0b 　'srtvedlmaA1٣é中文字\U0001f600!,.-\x1c\x85_<|endoftext|>\x00ß"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 70))) for _ in range(2000)]
    texts += ["<|endoftext|>" * 3, "a<|endoftext|> b", "'s", "'", "''s", " 's", "x'll've", "\n's", "'S", "'sfoo", "'refoo'r", "  ", "\n\n a", " a", "a" * 3000, "ab" * 2000, "aaab" * 501]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(4000))]
    got = token_counts.Counter(token_counts.default_tokenizer()).count(texts)
    assert got.tolist() == counts(library, texts)


def test_rounds_agree_with_one_merge_at_a_time():
    """Made vocabularies, in which one letter repeats: the lowest rank first, leftmost first, one merge a time."""
    rng = random.Random(5)

    class Made(token_counts.Vocabulary):
        def __init__(self, pairs):
            ids = {c: i for i, c in enumerate("abc")}
            for a, b in pairs:
                ids.setdefault(a + b, len(ids))
            self.size, keys = len(ids), np.array([ids[a] * len(ids) + ids[b] for a, b in pairs], np.int64)
            self.order = np.argsort(keys).astype(np.int32)
            self.keys, self.made = keys[self.order], np.array([ids[a + b] for a, b in pairs], np.int32)
            self.symbol = np.zeros(256, np.int32)
            self.symbol[[97, 98, 99]] = [0, 1, 2]
            self.beside = np.ones((256, 256), bool)

    for _ in range(20):
        have, pairs = list("abc"), []
        for _ in range(8):
            pair = (rng.choice(have), rng.choice(have))
            if pair[0] + pair[1] not in have:
                pairs.append(pair)
                have.append(pair[0] + pair[1])
        words = ["".join(rng.choice("aab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(1, 30))) for _ in range(60)]
        want = []
        for w in words:
            s = list(w)
            while found := [(pairs.index(p), i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in pairs]:
                _, i = min(found)
                s[i : i + 2] = [s[i] + s[i + 1]]
            want.append(len(s))
        assert token_counts.merged(Made(pairs), [w.encode() for w in words]).tolist() == want


def audit_wanted(documents, labels):
    rows, first = [], {}
    for i, t, *_ in documents:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    for i, t, _, source, _ in documents:
        t = t or ""
        ws = [w for w in t.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > first[t]}
        rows.append((source or "", {c for c in fails if fails[c]}, i is not None and i in good, i is not None and i in toxic))
    want, removed = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone, was = [r for r in left if c in r[1]], left
                left = [r for r in left if c not in r[1]]
                removed[part, c] += len(gone)
                failing = sum(c in r[1] for r in mine)
                want[part, "".join(order), step] = [len(left), len(gone), failing - sum(c in r[1] for r in was), sum(r[1] == {c} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_filter_audit(spark, docs, documents, none):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 600, 3)] + [(0, 0, 1), (400, None, 1), (None, 1, 1), (100, 1, None), (407, 1, 1), (407, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(700 + i, t, "en", s, 1) for i, (t, s) in enumerate([("SHOUT # now", "a"), ("x & y " * 150, None), (" ".join(f"w{j}" for j in range(250)), ""), (" ".join(f"w{j}" for j in range(250)), "z")])]
    given = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("part", F.lit("clash")).withColumn("words", F.lit(0))
    out = filter_audit.report(given, table)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    assert got == audit_wanted([*documents, *extra], labels) and any(v[4] for v in got.values()) and any(v[5] for v in got.values())
    assert filter_audit.report(none, table).count() == 0 == filter_audit.report(docs, table.limit(0)).filter("good_lost + toxic_lost > 0").count()


def test_filter_audit_of_other_filters(docs, spark):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.report(docs, table, text_failures=lambda text, ws: {"S": F.size(ws) < 5}, part_col="lang").collect()
    assert {r.filter_order for r in out} == {"SE", "ES"} and {r.part for r in out} == {"", "de", "en"}
    with pytest.raises(ValueError):
        filter_audit.report(docs, table, text_failures=lambda text, ws: {"E": F.size(ws) < 5})


def test_removal_polynomial():
    """Corners and Shapley values of random weights against counting."""
    from math import factorial

    rng = random.Random(2)
    weights = {frozenset(i for i in range(4) if m >> i & 1): rng.randint(0, 50) for m in range(16)}
    p = filter_audit.Removal(weights)
    gone = lambda s: sum(w for m, w in weights.items() if m & set(s))
    for m in range(16):
        s = [i for i in range(4) if m >> i & 1]
        assert p.corner(s) == gone(s)
    for i in range(4):
        total = sum(gone(o[: o.index(i) + 1]) - gone(o[: o.index(i)]) for o in permutations(range(4)))
        assert p.shapley(i) * factorial(4) == total
