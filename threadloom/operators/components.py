"""Connected components by alternating large and small stars, each round a few joins and pre-aggregated minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.spark import discard, materialise

#: Edges that a task works on at once, and edges that it keeps at most before it hands them on.
AT_ONCE, KEPT = 1 << 19, 1 << 20


def _are_stars(e: DataFrame) -> bool:
    """No node of e(u, v) has two v, or is both a u and a v. One pre-aggregated pass."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("c")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("c")))
    return ends.groupBy("n").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("t")).filter("c > 0 AND t > 1").isEmpty()


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges from each node of the batches (u, v) to the least of its component, which is often the same in other tasks."""
    both = pa.chunked_array([b.column(i) for i in (0, 1) for b in batches]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(both.dictionary)
    root = np.arange(len(order))
    place = np.empty_like(root)
    place[order.to_numpy()] = root
    ends, nodes = place[both.indices.to_numpy()], both.dictionary.take(order)
    u, v = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    below = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(below)), nodes.take(pa.array(root[below]))], names=["u", "v"])


def forests(edges: DataFrame) -> DataFrame:
    """u, v: edges with the components of edges(u, v), of which each task leaves at most one for each of its nodes.

    What is shuffled next grows with the nodes and tasks in place of the edges. A task that meets more than KEPT nodes hands on what it has and begins anew, so its memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        new = 0
        for batch in batches:
            held.append(batch)
            new += batch.num_rows
            if new >= AT_ONCE:
                held, new = [_stars(held)], 0
                if held[0].num_rows > KEPT:
                    yield held.pop()
        if held:
            yield _stars(held)

    return edges.filter("u <> v").select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges(u, v), of any orderable type; loops and repeats do no harm.

    Each round is written to the shared folder, so that a lost executor costs a re-read, and the round before
    it is deleted. The rounds grow with the logarithm of the longest path; they end when all edges lead from
    a node to its root, which an edge list that is so from the start shows without a round.
    """
    e = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, e = e, materialise(small.filter("u <> v").distinct(), "stars")
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
