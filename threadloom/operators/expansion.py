"""Bounded, best-first loading of a graph: ranks by range, budgets, quotas, and the payload of what was taken."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.graph import EXPANSION, NOT_EXPANDED, degrees, restrict
from threadloom.spark import discard, materialise


def ranked(df: DataFrame, order: list[Column], group: str | None = None, name: str = "rank") -> DataFrame:
    """df with the place of each row by order, from 1, in the whole or within group (null is a group).

    Rows are range-sorted over tasks, written, and numbered by their place in a partition plus the rows before it, so
    neither the whole nor a large group is one task. order must tell all rows apart for a result that does not depend on partitions.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    sorted_by = [F.col("__group"), *order]
    dealt = df.withColumn("__group", key).repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranked")
    part = F.shiftright("__at", 33)
    held = dealt.groupBy(F.col("__group").alias("g"), part.alias("p")).agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("g").alias("__g"), F.col("p").alias("__p"), (F.col("first") - before - 1).alias("__shift"))
    out = dealt.join(held, (F.col("__group") == F.col("__g")) & (part == F.col("__p")))
    return out.withColumn(name, F.col("__at") - F.col("__shift")).drop("__group", "__at", "__g", "__p", "__shift")


def _weight() -> Column:
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*EXPANSION.items()))), F.col("type")), F.lit(2))


def expand(edges: DataFrame, seeds: DataFrame, budget: int, depth: int = 2, quota: int | None = None) -> DataFrame:
    """id, hops, strength, via, seed: at most budget nodes around seeds(id), the strongest first.

    In every step each unseen neighbour of what was taken last has the sum of EXPANSION over its edges to it as
    strength (relations in NOT_EXPANDED do not lead on), and belongs to the seed of the neighbour via that its
    heaviest edges lead to (the least id of equal ones). Of each seed's the quota strongest go on, and of all those
    the strongest until budget is reached, the least id first where strengths are equal. Seeds count, the least ids
    first if they alone pass the budget; they have 0 hops, no via, and are their own seed.

    Ranks are taken by range sort, and each step is written, so no task sees a whole frontier.
    """
    kept = edges.filter(~F.col("type").isin(*NOT_EXPANDED) & (F.col("source") != F.col("target"))).withColumn("w", _weight())
    ends = kept.select(F.col("source").alias("from"), F.col("target").alias("id"), "w").unionByName(kept.select(F.col("target").alias("from"), F.col("source").alias("id"), "w"))
    pairs = ends.groupBy("from", "id").agg(F.sum("w").alias("w"))
    first = ranked(seeds.select("id").distinct(), [F.col("id")]).filter(F.col("rank") <= budget)
    none = F.lit(None).cast("string")
    taken = materialise(first.select("id", F.lit(0).alias("hops"), F.lit(0).cast("long").alias("strength"), none.alias("via"), F.col("id").alias("seed")), "taken")
    left = budget - taken.count()
    for hop in range(1, depth + 1):
        if left <= 0:
            break
        last = taken.filter(F.col("hops") == hop - 1).select(F.col("id").alias("from"), "seed")
        met = pairs.join(last, "from").join(taken.select("id"), "id", "left_anti")
        best = F.min_by(F.struct("from", "seed"), F.struct((-F.col("w")).alias("w"), "from"))
        found = met.groupBy("id").agg(F.sum("w").alias("strength"), best.alias("b")).select("id", "strength", F.col("b.from").alias("via"), "b.seed")
        order = [F.desc("strength"), F.col("id")]
        if quota is not None:
            found = ranked(found, order, "seed", "place").filter(F.col("place") <= quota).drop("place")
        chosen = ranked(found, order).filter(F.col("rank") <= left)
        more = materialise(taken.unionByName(chosen.select("id", F.lit(hop).alias("hops"), "strength", "via", "seed")), "taken")
        discard(taken)
        left, taken = budget - more.count(), more
    return taken


def load(assets: DataFrame, edges: DataFrame, ids: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The assets among ids(id), at most budget of them by id, and the edges whose both ends are among those: what an investigation or a cluster shows."""
    found = assets.join(ids.select("id").distinct(), "id", "left_semi")
    nodes = ranked(found, [F.col("id")], name="__rank").filter(F.col("__rank") <= budget).drop("__rank")
    return nodes, restrict(edges, nodes)


def payload(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, title: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a view is sent: nodes (id, label, kind, degree, focus), edges (id, source, target, relation, weight), and one row of stats (nodes, edges, kinds, density).

    nodes are assets, edges already restricted to them. The label is the value, or the id without one. focus(id) marks nodes.
    """
    marked = nodes if focus is None else nodes.join(focus.select("id").distinct().withColumn("focus", F.lit(True)), "id", "left")
    mark = F.lit(False) if focus is None else F.coalesce("focus", F.lit(False))
    shown = marked.join(degrees(edges), "id", "left").select("id", F.coalesce(title if title is not None else F.col("value"), F.col("id")).alias("label"), F.col("type").alias("kind"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), mark.alias("focus"))
    drawn = edges.select("id", "source", "target", F.col("type").alias("relation"), _weight().cast("long").alias("weight"))
    several = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    counted = shown.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("kind").alias("kinds")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges")))).join(F.broadcast(several))  # rows of one
    n = F.col("nodes")
    return shown, drawn, counted.select("nodes", "edges", "kinds", F.when(n > 1, F.round(2 * F.col("pairs") / (n * (n - 1)), 5)).otherwise(0.0).alias("density"))


def highlighted(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """id: chosen(id) and what an edge ties to it."""
    to = edges.join(chosen.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    into = edges.join(chosen.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    return chosen.select("id").unionByName(to).unionByName(into).distinct()


def difference(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, change: added, removed or changed between two versions of a table; rows that are alike are left out.

    Rows are compared by a digest of their other columns, written as JSON with nulls; only keys and digests meet. A
    repeated key counts with all its rows, in any order.
    """
    rest = sorted(c for c in new.columns if c != key)
    if rest != sorted(c for c in old.columns if c != key):
        raise ValueError("both versions need the same columns")
    content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(content, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = lambda df, name: df.groupBy(key).agg(F.struct(part(1), part(16), F.count(F.lit(1))).alias(name))
    before, after = sums(old, "before").withColumnRenamed(key, "__k"), sums(new, "after")
    both = before.join(after, F.col("__k").eqNullSafe(F.col(key)), "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select(F.coalesce(key, "__k").alias(key), change.alias("change")).filter("change IS NOT NULL")


def merged_payload(shown: DataFrame, loaded: DataFrame) -> DataFrame:
    """shown and what loaded has beside it, by id: what is shown stays as it is."""
    return shown.unionByName(loaded.join(shown.select("id"), "id", "left_anti").dropDuplicates(["id"]))
