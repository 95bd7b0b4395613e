"""Near-dedup, language model, suffix dedup, BPE and toxicity against brute force, the library, and held-out labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bpe, brown, near_dedup, suffix_dedup, toxicity
from threadloom.llm.shingles import shingle_sets
from threadloom.operators.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_groups(docs, documents, none, k, percent):
    sets = [shingles(t, k) for _, t, *_ in documents]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(documents[i][0])
    want = Counter()
    for i, s in enumerate(sets):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        want[documents[i][0], len(s), least, documents[i][0] == least] += 1
    got = near_dedup.near_groups(docs, k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    left = near_dedup.near_dedup(docs, k, percent)
    assert left.columns == docs.columns and left.count() == sum(n for w, n in want.items() if w[3])
    assert near_dedup.near_groups(none, k, percent).count() == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_shingles_of_a_run_with_few_words(n):
    """A text that is hashed alone has the set that it has beside a long one."""
    short, long = " ".join("abcdef"[:n]), " ".join(map(str, range(50)))
    (alone,) = shingle_sets(pa.array([short]), 5)
    beside, _ = shingle_sets(pa.array([short, long]), 5)
    assert len(alone) == max(1, n - 4) and alone.tolist() == beside.tolist()


def test_near_dedup_of_a_short_text_alone(spark):
    docs = spark.createDataFrame([(1, "two words", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert near_dedup.near_dedup(docs).count() == 1


def test_links_across_one_bucket(spark):
    """A chain whose ends are not similar is one component, also where no pair with the least member is a link."""
    words = [f"w{i}" for i in range(300)]
    d = spark.createDataFrame([(i, " ".join(words[7 * i : 7 * i + 150])) for i in range(12)], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_groups(d, 3, 85).collect()} == {0}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_language_model(docs, documents, none):
    train = docs.filter(F.col("doc_id") % 4 != 1)
    taught = [t for i, t, *_ in documents if i is not None and i % 4 != 1]
    c = Counter(w for t in taught for w in brown.tokens(t))
    n, v = sum(c.values()), len(c)
    model = brown.fit(train, head=50, units=60, endings=20, classes=6, rounds=4)
    assert (model.total, model.distinct) == (n, v)
    got = brown.score(docs, model).collect()
    want = Counter((i, len(brown.tokens(t)), sum(w in c for w in brown.tokens(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in brown.tokens(t)), 4)) for i, t, *_ in documents)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    # of every class the words that are known and one that is not share all its probability, and so do the classes
    units = brown.Units(model.words, model.endings)
    by = defaultdict(list)
    for w, k in c.items():
        by[int(model.classes[units.of([w])[0]])].append(k)
    for k, counts in by.items():
        assert (sum(counts) + 0.5 * len(counts) + 0.5) / 10 ** model.denominators[k] == pytest.approx(1)
    assert (10**model.transitions).sum(1) == pytest.approx(1)
    assert brown.score(none, model).count() == 0
    blank = brown.score(docs, brown.fit(none)).collect()
    assert len(blank) == len(documents) and all(r.n_known == 0 for r in blank)


def test_language_model_clusters_every_word_seen_often(spark):
    """1,600 words of one ending, half of which only ever follow the other half, come to classes that the halves do not share."""
    rng = random.Random(3)
    firsts, seconds = ([f"{x}{i}zzz".encode() for i in range(800)] for x in "xy")
    texts = []
    for _ in range(12):
        rng.shuffle(firsts)
        rng.shuffle(seconds)
        texts += [b" ".join(w for pair in zip(firsts[i : i + 20], seconds[i : i + 20]) for w in pair).decode() for i in range(0, 800, 20)]
    model = brown.fit(spark.createDataFrame([(t,) for t in [*texts, "seldom seen"]], "text string").repartition(3), classes=6)
    assert len(model.words) == 1601  # and the end
    units = brown.Units(model.words, model.endings)
    one, two = (Counter(model.classes[units.of(ws)].tolist()) for ws in (firsts, seconds))
    assert len(set(units.of(firsts + seconds))) == 1600 and not set(one) & set(two)
    assert min(units.of([b"seldom", b"seen"])) >= 1601


def test_words_are_told_apart_in_arrow(documents):
    rng = random.Random(3)
    texts = [t for _, t, *_ in documents] + ["A\u00a0b \x1c\x1f" + chr(0x85) + " " + " ".join("xY\u00e9\u65e5"[: rng.randint(1, 4)] * rng.randint(0, 30) for _ in range(300))]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.string())[3:-1], pa.array([], pa.string()), pa.array(["", None], pa.string())):
        words, n = brown.split(column)
        want = [brown.tokens(t) for t in column.to_pylist()]
        assert n.tolist() == [len(t) for t in want] and words.to_pylist() == [w for t in want for w in t]
        assert brown.word_keys(words).tolist() == brown.hashes(words.to_pylist()).tolist()
        assert brown.word_keys(words[2:]).tolist() == brown.hashes(words.to_pylist()[2:]).tolist()
    units = brown.Units(brown.hashes([b"", b"one", b"three"]), [b"ree", b"o", b"xyz"])
    assert units.of([b"three", b"tree", b"o", b"oo", b"xyz", b"", b"one", b"ree"]) == [2, 3, 4, 6, 5, 0, 1, 3]


def test_neighbours_against_brute_force(spark, docs, documents, monkeypatch):
    words, want = brown.hashes([brown.END, b"na", b"the", b"one"]), Counter()
    units = brown.Units(words, [b"ine"])
    rows = [[0, *units.of(brown.tokens(t))] for _, t, *_ in documents]
    for row in rows:
        for u, v in zip(row, row[1:]):
            want[u, v] += 1
            want[v, ~u] += 1
    for fold in (brown.FOLD, 1):
        monkeypatch.setattr(brown, "FOLD", fold)
        near, got = brown.neighbours(docs.select("text"), words, [b"ine"]).collect(), Counter()
        for r in near:
            for other, n, side in ((r.after, r.after_n, 0), (r.before, r.before_n, -1)):
                got.update({(r.unit, int(o) ^ side): int(k) for o, k in zip(np.frombuffer(other, np.int32), np.frombuffer(n, np.int64), strict=True)})
        assert got == want and len(near) == len({u for u, _ in want})


def spans_wanted(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append(tuple(map(tuple, spans)))
    return out


@pytest.mark.parametrize("hot,length", [(2048, 400), (1, 400), (2048, 100)])
def test_suffix_dedup(docs, documents, none, monkeypatch, hot, length):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [(t or "").encode() for _, t, *_ in documents]
    want = Counter()
    for (i, *_), t, spans in zip(documents, texts, spans_wanted(texts, length), strict=True):
        keep = bytearray(t)
        for a, b in reversed(spans):
            del keep[a:b]
        want[i, len(t), spans, bytes(keep)] += 1
    out = suffix_dedup.suffix_dedup(docs.withColumn("spans", F.lit(1)), length)
    assert Counter((r.doc_id, r.n_bytes, tuple((s.a, s.b) for s in r.spans), bytes(r.kept)) for r in out.collect()) == want
    assert any(k[2] for k in want) and suffix_dedup.suffix_dedup(none, length).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_passages_are_told_and_long_texts_go_by_pieces(spark, monkeypatch, block):
    from threadloom.llm import shingles

    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(n))
    short, long = prose(56), prose(130)
    assert 220 < len(short) < 400 < len(long)
    rows = [(1, f"{prose(900)} {short} {prose(30)}"), (2, f"{prose(20)} {short} {prose(10)}"), (3, f"{long} {prose(2000)}"), (4, f"{prose(1500)} {long}"), (5, prose(500)), (6, prose(40)), (7, None)]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id int, text string"), passages=True).collect()
    assert {r.doc_id: (r.n_passages, len(r.spans)) for r in out} == {1: (1, 0), 2: (1, 0), 3: (1, 1), 4: (1, 1), 5: (0, 0), 6: (0, 0), 7: (0, 0)}
    want = spans_wanted([(t or "").encode() for _, t in rows], 400)
    assert {r.doc_id: tuple((s.a, s.b) for s in r.spans) for r in out} == dict(zip((i for i, _ in rows), want, strict=True))


@pytest.mark.parametrize("words,most", [(40, 12), (75, 60)])
def test_a_passage_of_very_many_texts_is_not_cut_into_all_its_strings(spark, monkeypatch, words, most):
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(n))
    passage, rows, made = prose(words), [], {}
    for i in range(60):
        around = prose(90) if i % 5 or not i else around  # some have what stands before it in common too
        rows.append((i, f"{around} {passage} {prose(90)}"))
    write = suffix_dedup.materialise
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, name: made.setdefault((name, len(made)), write(df, name)))
    monkeypatch.setattr(suffix_dedup, "discard", lambda *tables: None)
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    want = spans_wanted([t.encode() for _, t in rows], 400)
    assert [tuple((s.a, s.b) for s in r.spans) for r in sorted(out)] == want and any(want)
    # with a row for each string there are more than a hundred of each block
    blocks = sum(t.filter("n > 8").count() for (name, _), t in made.items() if name == "wanted")
    assert blocks >= 30 and sum(t.count() for (name, _), t in made.items() if name in ("pieces", "strings")) <= most * blocks


def test_long_text_has_the_shingles_of_its_pieces(monkeypatch):
    from threadloom.llm import shingles

    text = "One two  three\tfour five\n" * 40 + "x" * 300 + " end of it"
    (whole,) = shingle_sets(pa.array([text]), 3)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    (pieces,) = shingle_sets(pa.array([text]), 3)
    assert (whole == pieces).all() and len(whole) == len({tuple(text.lower().split()[i : i + 3]) for i in range(len(text.split()) - 2)})


def test_recurring_against_all_pairs():
    rng = random.Random(5)
    for _ in range(60):
        m, length = rng.randint(2, 9), 12
        far = np.array([rng.randint(0, 8) for _ in range(m)])
        near = np.array([rng.randint(0, f) for f in far])
        make = lambda n: bytes(rng.choice((0, 97)) for _ in range(n))
        leads, suffixes = [make(f) for f in far], [b"GRAM" + make(length - 4 - n) for n in near]
        got = suffix_dedup.recurring(leads, suffixes, near, far, length)
        string = lambda i, d: (leads[i][far[i] - d :] + suffixes[i])[:length] if near[i] <= d <= far[i] else None  # noqa: E731, B023
        for i in range(m):
            for d in range(far.max() + 1):
                s = string(i, d)
                assert got[i, d] == (s is not None and any(string(j, d) == s for j in range(m) if j != i))


def test_bpe_agrees_with_the_library(docs, documents, none, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CUT_ONE_IN", 4)  # many joins
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter()
    for i, t, *_ in documents:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    out = bpe.encode(docs.withColumn("ids", F.lit("clash")), decoded=True)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out.collect()) == want
    assert Counter((r.doc_id, r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()) == Counter((i, d) for (i, _, d), n in want.items() for _ in range(n))
    assert bpe.encode(none).count() == 0


def test_bpe_repairs_joins():
    """Where a join disagrees, the window grows until its outer words agree."""
    encoder = bpe.Encoder(bpe.default_tokenizer(), {})
    texts = [[b"some words here", b" and there", b" x"]]
    want = encoder.encode(texts)
    sides = (b"here", b"and")
    encoder.joins[sides] = False
    assert encoder.encode(texts) == want


def test_bpe_joins_after_a_long_word():
    """The word left of a join is whole, however long it is and whatever white space follows."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    for word in ("\u8a9e" * 100 + "x", "\u8a9e" * 400, "y" * 600):
        encoder = bpe.Encoder(bpe.default_tokenizer(), {})
        chunks = [f"before {word} ", "\n after"]
        (got,) = encoder.encode([[c.encode() for c in chunks]])
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode("".join(chunks), add_special_tokens=False).ids
        assert (word.encode(), b"after") in encoder.joins


def test_toxicity(spark):
    rng = random.Random(11)
    plain = [f"word{i}".translate(str.maketrans("0123456789", "qwertyuiop")) for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(40)]
        if i % 6 == 0:
            w[rng.randrange(40)], w[rng.randrange(40)] = rng.choice(("grumblefoot", "Grumb1ef00t!", "grumblеfooted")), "snortface,"  # noqa: RUF001
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(900, None), (901, ""), (None, "grumblefoot snortface")]
    labels += [(902, 1), (None, 1), (3, None), (5, 7)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y.filter("doc_id % 5 <> 0 OR doc_id IS NULL"))
    got = {r.doc_id: r.score for r in toxicity.score(d.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i in range(0, 600, 5)]
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert got[900] == got[901] < 0.3 and got[None] > 0.5
    spared = toxicity.fit(d, y, exceptions=("grumblefoot", "snortface"))
    assert {r.doc_id: r.score for r in toxicity.score(d, spared).collect()}[None] < 0.3
    nothing = toxicity.fit(d, y.limit(0))
    assert [r.score for r in toxicity.score(d.limit(2), nothing).collect()] == [0.5, 0.5]
    assert toxicity.score(d.limit(0), model).count() == 0


def test_fold():
    assert toxicity.fold("You are an 1D10T!!, ｓｔｕｐｉｄ") == " you are an idiot stupid "  # noqa: RUF001
