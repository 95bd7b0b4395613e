"""MinHash near-dedup with tensored banding.

Two collections of half keys are made, each half key from some rows of min-hashes. A table key is a pair of
one half key from either collection, so halves^2 tables of 2 * rows min-hashes cost 2 * halves * rows
min-hashes, about the square root of what separate tables would. A table key can only be shared if both its
halves are, so pairs are formed only from half keys that two texts share.

Texts with equal sets are one node from the start. In each bucket (texts that share a table key) all are
first held against a leader, the node that shares the most half keys with others, as the original of a
group of copies does. In buckets that this leaves in several components, shingles that only one node of
them all has are counted: a pair can share no more than either has besides, and where that is too little
for the similarity, or the sizes are, it is no pair. The others across components are held against each
other. What lies in one component already needs no check. Every link is confirmed on the full sets.
A pair of similarity s is missed with a probability of about 2 * (1 - s^rows)^halves; banding() holds that to
MISS at the similarity asked for, with the most rows that MOST_HALVES allow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import discard, materialise, parts, row_key, texts_in_small_batches
from threadloom.operators.components import components
from threadloom.llm.shingles import mix, shingle_sets

MISS, MOST_HALVES = 0.0001, 25
WORDS, PERCENT = 5, 80
#: Low bits of min-hashes by which pairs across components are sifted before their sets are read, and how many
#: standard deviations beyond the expected count of unlike bits is too far: a chance of 0.00001 at the similarity asked for.
SKETCH, SIGMAS = 1024, 4.3
#: A key list goes to all executors up to this many bytes; a larger one is shuffled.
BROADCAST_BYTES = 64_000_000


def banding(percent: int) -> tuple[int, int]:
    """rows, halves: the most rows, so the fewest pairs of dissimilar texts, whose halves are at most MOST_HALVES."""
    of = lambda rows: math.ceil(math.log(MISS / 2) / math.log(1 - (min(percent, 99) / 100) ** rows))
    rows = max([1, *(r for r in range(1, 17) if of(r) <= MOST_HALVES)])
    return rows, of(rows)


def _signatures(sets, rows: int, halves: int):
    """digest, size and the 2 * halves half keys of each set; no keys for an empty one."""
    import xxhash

    seeds = np.random.default_rng(20).integers(1, 2**63, (2, 2 * halves * rows), np.uint64)
    factor, shift = (seeds[0] << np.uint64(1)) | np.uint64(1), mix(seeds[1])
    base = np.uint64(0xD6E8FEB86659FD93)
    for s in sets:
        keys = None
        if len(s):
            least = np.full(len(factor), 2**64 - 1, np.uint64)
            for i in range(0, len(s), 2048):
                np.minimum(least, ((s[i : i + 2048, None] ^ shift) * factor).min(axis=0), out=least)
            groups = mix(least).reshape(2 * halves, rows)
            keys = groups[:, 0]
            for j in range(1, rows):
                keys = keys * base + groups[:, j]
            keys = mix(keys).view(np.int64)
        yield xxhash.xxh3_128_digest(s.tobytes()), len(s), keys


def signatures(docs: DataFrame, words: int, rows: int, halves: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (row_key), node (16-byte digest of the set; equal sets, equal nodes), n (set size), a, b (half keys)."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 2):
                found = list(_signatures(shingle_sets(part.column(2), words), rows, halves))
                longs = [[None if k is None else k[x : x + halves] for _, _, k in found] for x in (0, halves)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in longs)], names=["doc_id", "row", "node", "n", "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, row binary, node binary, n long, a array<long>, b array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """key, node, n, w: the table keys of each node whose halves other nodes share, and how often its halves are found in all."""
    halves = None
    for side in ("a", "b"):
        each = nodes.select("node", "n", F.posexplode(side).alias("i", "h")).select("node", "n", F.lit(side).alias("side"), F.xxhash64(F.lit(side), "i", "h").alias("h"))
        halves = each if halves is None else halves.unionByName(each)
    shared = halves.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    mine = halves.join(shared, "h").groupBy("node", "n").agg(F.sum("c").alias("w"), *(F.collect_list(F.when(F.col("side") == s, F.col("h"))).alias(s) for s in ("a", "b")))
    pairs = mine.select("node", "n", "w", "a", F.explode("b").alias("y")).select("node", "n", "w", "y", F.explode("a").alias("x"))
    return pairs.select(F.xxhash64("x", "y").alias("key"), "node", "n", "w")


def _near(x: str, y: str, percent: int):
    """Sizes alone allow the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(u, v) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["u", "v"])

    one, two = (sets.select(F.col("node").alias(k), F.col("set").alias(s)) for k, s in (("u", "x"), ("v", "y")))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y").mapInArrow(run, "u binary, v binary")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node, set (sorted hashes) for wanted(row, node), one row per node."""
    if wanted.count() * 48 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text")).join(wanted, "row").select("node", "text")

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())], names=["node", "set"])

    # rows that repeat id and text give the same set again
    return texts.mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


def _contested(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, e, bits: how many of its shingles another of nodes has too, and the low bits of SKETCH min-hashes."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                each = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                index = np.repeat(np.arange(len(each)), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), pa.array(np.concatenate(each))], names=["node", "s"])

    def sketch(batches):
        seeds = np.random.default_rng(21).integers(1, 2**63, (2, SKETCH), np.uint64)
        factor, shift = (seeds[0] << np.uint64(1)) | np.uint64(1), mix(seeds[1])
        for batch in batches:
            out = []
            for x in batch.column(1):
                s, least = np.frombuffer(x.as_buffer(), np.uint64), np.full(SKETCH, 2**64 - 1, np.uint64)
                for i in range(0, len(s), 256):
                    np.minimum(least, ((s[i : i + 256, None] ^ shift) * factor).min(axis=0), out=least)
                out.append(np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.as_buffer()) // 8 for x in batch.column(1)], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["node", "all", "bits"])

    mine = sets.join(nodes, "node", "left_semi").select("node", "set")
    each = mine.mapInArrow(run, "node binary, s long")
    alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sketched = mine.mapInArrow(sketch, "node binary, all long, bits array<long>")
    return sketched.join(alone, "node", "left").select("node", (F.col("all") - F.coalesce("alone", F.lit(0))).alias("e"), "bits")


def _across(nodes: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of nodes(node, n, root, e, bits, a, b) of unlike roots that share a half key of either side and may be similar, each once.

    A pair is made where its first common half key of side a meets; sizes, shareable shingles and sketches
    are compared there, so what cannot be similar makes no row.
    """
    each = nodes.select("node", "n", "root", "e", *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(SKETCH // 64)), F.transform("a", lambda h: F.hash(h)).alias("a"), F.transform("b", lambda h: F.hash(h)).alias("b"), F.posexplode("a").alias("i", "h"))
    x, y = each.alias("x"), each.alias("y")
    both = F.least("x.e", "y.e")
    able = (both * 100 >= (F.col("x.n") + F.col("y.n") - both) * percent) & _near("x.n", "y.n", percent)
    unlike = F.lit(0)
    for i in range(SKETCH // 64):
        unlike = unlike + F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}")))
    odds = (1 - percent / 100) / 2  # of one low bit to differ at the similarity asked for
    close = unlike <= SKETCH * odds + SIGMAS * math.sqrt(SKETCH * odds * (1 - odds))
    first = F.array_position(F.zip_with("x.a", "y.a", lambda p, q: p == q), True) == F.col("x.i") + 1
    same = (F.col("x.i") == F.col("y.i")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    tensor = F.exists(F.zip_with("x.b", "y.b", lambda p, q: p == q), lambda e: e)
    return x.join(y, same & able & close & first & tensor).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with root, of the buckets that lie in several components of found(node, root)."""
    placed = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    return materialise(placed.join(several, "key", "left_semi"), "mixed")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row (row_key), n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Rows are linked if their shingle sets are similar by
    percent or more; component_id is the least doc_id that links reach, null only if all these are null, and
    kept is doc_id <=> component_id. Null, empty and blank texts have no shingles, are linked with nothing
    and kept. Rows that repeat an id are told apart by their text. An empty table gives an empty result.
    """
    signed = materialise(signatures(texts_in_small_batches(docs), words, *banding(percent), id_col, text_col), "signatures")
    nodes = materialise(signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "nodes")
    every = materialise(buckets(nodes), "buckets")
    lead = F.max(F.struct("w", "node", "n")).alias("f")
    firsts = every.groupBy("key").agg(lead, F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key", F.col("f.node").alias("u"), F.col("f.n").alias("m"))
    firsts = materialise(firsts, "leaders")
    members = materialise(every.join(firsts.select("key"), "key", "left_semi"), "shared")
    discard(every)
    pair = (F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))
    tested = materialise(members.join(firsts, "key").filter((F.col("u") != F.col("node")) & _near("n", "m", percent)).select(*pair).distinct(), "stars")
    sets = materialise(_sets(docs, nodes.join(members, "node", "left_semi").select("row", "node"), words, id_col, text_col), "sets")
    links = materialise(confirmed(tested, sets, percent), "links")
    found = components(links)
    mixed = _mixed(members, found)
    rest = mixed.select("node", "n", "root").distinct()
    rest = rest.join(_contested(rest.select("node"), sets), "node").filter(F.col("e") * 100 >= F.col("n") * percent)
    rest = materialise(rest.join(nodes.select("node", "a", "b"), "node"), "contested")
    more = _across(rest, percent).join(tested, ["u", "v"], "left_anti")
    more = materialise(confirmed(more, sets, percent), "more_links")
    found = components(links.unionByName(more))
    discard(firsts, members, tested, sets, links, mixed, rest, more)
    rooted = nodes.select("node", "id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    out = signed.select("doc_id", "row", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_groups keeps, with all their columns."""
    gone = near_groups(docs, words, percent, id_col=id_col, text_col=text_col).filter("NOT kept").select("row")
    return docs.join(gone, row_key(docs[id_col], docs[text_col]) == gone["row"], "left_anti")
