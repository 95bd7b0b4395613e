"""A Merkle manifest of a dataset: digests, roots and inclusion proofs that a reader can check row by row.

Leaves are ordered within their group and numbered by a range sort. A tree of runs of eight stands on them: while
several nodes remain, every run of eight (the last may be shorter, even of one) becomes the digest of its nodes'
digests. Aligned blocks of 8^3 leaves are groups of a distributed job each: a recursive postorder traversal of the
block returns the digest of a subtree and, while it unwinds, appends to the leaves below what stands beside it.
The roots of the blocks are the leaves of another such job, until a group has one node left, its subroot. The
subroots, ordered by group, are numbered and traversed likewise up to the root.

On the way up only digests are kept. On the way down each block is traversed once more with the siblings of its
own root at hand, so no proof is shuffled: a leaf's proof leaves the task that made it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import discard, materialise, unused

FAN, HEIGHT = 8, 3
BLOCK = FAN**HEIGHT
PROOF = "array<struct<before:string,after:string>>"
ARROW_PROOF = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, or a hyphen if it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a node's digest and its proof lead to."""
    return F.aggregate(proof, node, lambda at, run: F.sha2(F.concat(run["before"], at, run["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level and left to right, as one text."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), "")


def depth(n: int) -> int:
    """Levels above n nodes."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def traverse(nodes: list[str], height: int, lo: int = 0, paths: list[list[dict]] | None = None) -> str:
    """The digest of the subtree of that height over nodes[lo:]; what stands beside its nodes is appended to the paths of the leaves below them."""
    if not height:
        return nodes[lo]
    width = FAN ** (height - 1)
    begins = range(lo, min(lo + FAN * width, len(nodes)), width)
    below = [traverse(nodes, height - 1, b, paths) for b in begins]
    if paths is not None:
        for i, b in enumerate(begins):
            beside = {"before": "".join(below[:i]), "after": "".join(below[i + 1 :])}
            for path in paths[b : b + width]:
                path.append(beside)
    return hashlib.sha256("".join(below).encode()).hexdigest()


def numbered(rows: DataFrame, group: str, order: list[str], place: str, size: str) -> DataFrame:
    """rows with their place within the group, from 0, by order, and the group's size.

    A range sort deals out any group, and any run of equal keys, over tasks. It is written, as its bounds come from
    a sample that a second run may take otherwise; places are those within a partition and group, plus the rows of
    earlier partitions. The table of partition sizes has a row per partition and one more per group at most.
    """
    at, first, before = unused(rows, "sorted_at", "first_at", "rows_before")
    dealt = rows.withColumn(at, F.monotonically_increasing_id())
    keys = [group, *order, at]
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    dealt = materialise(dealt, "ordered")
    part = F.shiftright(F.col(at), 33)
    held = dealt.groupBy(F.col(group).alias("g"), part.alias("p")).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
    running = W.partitionBy("g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("g", "p", first, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before), F.sum("n").over(W.partitionBy("g")).alias(size))
    held = held.select(F.col("g").alias(f"{first}_g"), F.col("p").alias(f"{first}_p"), first, before, size)
    found = dealt.join(held, (F.col(group) == F.col(f"{first}_g")) & (part == F.col(f"{first}_p")))
    return found.withColumn(place, F.col(at) - F.col(first) + F.col(before)).drop(at, first, before, f"{first}_g", f"{first}_p")


def _up(nodes: DataFrame) -> list[DataFrame]:
    """nodes(g, at, size, node), the roots of their blocks as nodes, and so on until every group has one; at least one step."""

    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        size = rows.column("size")[0].as_py()
        digest = traverse(rows.column("node").to_pylist(), min(HEIGHT, depth(size)))
        return pa.table([[rows.column("g")[0].as_py()], [rows.column("at")[0].as_py() // BLOCK], [-(-size // BLOCK)], [digest]], schema=schema)

    schema = pa.schema([("g", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("node", pa.string())])
    levels, largest = [nodes], None
    while largest is None or largest > 1:
        below = levels[-1].select(*schema.names, F.floor(F.col("at") / BLOCK).alias("block"))
        levels.append(materialise(below.groupBy("g", "block").applyInArrow(root, "g string, at long, size long, node string"), "block_roots"))
        largest = levels[-1].agg(F.max("size")).first()[0] or 1
    return levels


def _down(nodes: DataFrame, above: DataFrame, results: list[str], names: list[str]) -> DataFrame:
    """nodes with root, subroot and proof (named as results): the runs beside each node up to its block's root, and then those of above(g, at, root, subroot, proof) for the block.

    names are those of g, at, size and node in nodes.
    """
    g, at, size, node = names
    (block,) = unused(nodes, "block")
    keep = nodes.columns
    left = nodes.withColumn(block, F.floor(F.col(at) / BLOCK))
    right = above.select(F.col("g").alias(g), F.col("at").alias(block), "root", "subroot", "proof")
    kinds = T._parse_datatype_string(f"root string, subroot string, proof {PROOF}").fields
    schema = T.StructType([*nodes.schema.fields, *(T.StructField(r, k.dataType) for r, k in zip(results, kinds, strict=True))])

    def unwind(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.sort_by(at)
        leaves = rows.column(node).to_pylist()
        paths: list[list[dict]] = [[] for _ in leaves]
        traverse(leaves, min(HEIGHT, depth(rows.column(size)[0].as_py())), 0, paths)
        up = own.column("proof")[0].as_py()
        made = [pa.array([own.column(c)[0].as_py()] * len(leaves), pa.string()) for c in ("root", "subroot")]
        return pa.table([*(rows.column(c) for c in keep), *made, pa.array([p + up for p in paths], ARROW_PROOF)], names=[*keep, *results])

    return left.groupBy(g, block).cogroup(right.groupBy(g, block)).applyInArrow(unwind, schema)


def manifest(rows: DataFrame, leaf_col: str = "leaf", group_col: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """rows with root, subroot and proof: of the whole table, of the row's group, and the runs beside the row's path to the root, lowest first.

    leaf_col holds digests as lowercase hex, none null. Groups are ordered null first and then bytewise, rows within
    one by order_col, null first, and by leaf; equal leaves of equal order may take each other's place. A run of
    one has an empty proof step; the only leaf of a group is its subroot, and the only group's subroot the root.
    Columns named as results are replaced, all others stay, so give it few; an empty table gives none.
    """
    results = ["root", "subroot", "proof"]
    own = rows.drop(*results)
    g, at, size = unused(own, "g", "at", "size")
    keyed = materialise(own.withColumn(g, F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))), "leaves")
    leaves = numbered(keyed, g, [order_col, leaf_col], at, size)
    names = [g, at, size, leaf_col]
    levels = _up(leaves.select(*(F.col(c).alias(x) for c, x in zip(names, ("g", "at", "size", "node"), strict=True))))
    discard(keyed)
    groups = levels[-1].select(F.lit("").alias("all"), "g", F.col("node").alias("subroot"))
    tops = numbered(groups, "all", ["g"], "at", "size").withColumnsRenamed({"g": "group", "all": "g"}).withColumn("node", F.col("subroot"))
    tree = _up(tops)
    above = tree[-1].select("g", "at", F.col("node").alias("root"), F.lit(None).cast("string").alias("subroot"), F.array().cast(PROOF).alias("proof"))
    inner = ["g", "at", "size", "node"]
    for level in reversed(tree[1:-1]):
        above = _down(level, above, results, inner)
    ends = ["of_all", "no_subroot", "proof"]
    above = _down(tops, above, ends, inner).select(F.col("group").alias("g"), F.lit(0).cast("long").alias("at"), F.col("of_all").alias("root"), "subroot", "proof")
    for level in reversed(levels[1:-1]):
        above = _down(level, above, results, inner)
    return _down(leaves, above, results, names).drop(g, at, size)
