"""Clusters kept up to date as edges arrive: only the labels that new edges touch are read, merged ids leave tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.components import components
from threadloom.spark import discard, materialise

LABELS = "node string, cluster string, born long, bucket int"
TOMBSTONES = "old string, survivor string"
#: Label rows lie in so many folders by the hash of their node; a batch reads those of its nodes.
BUCKETS = 256


def bucket(node: str = "node"):
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int").alias("bucket")


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Labels and tombstones before the first batch."""
    return spark.createDataFrame([], LABELS), spark.createDataFrame([], TOMBSTONES)


def looked_up(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """The labels of ends(node, bucket). Only the folders of their buckets, BUCKETS numbers at most, are listed and read."""
    wanted = [r[0] for r in ends.select("bucket").distinct().collect()]
    return labels.filter(F.col("bucket").isin(wanted)).join(ends.select("node", "bucket"), ["bucket", "node"], "left_semi")


def absorb(labels: DataFrame, tombstones: DataFrame, edges: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
    """The labels to be added, and the tombstones to stand from now on, after edges(u, v) have arrived as batch number batch.

    labels(node, cluster, born, bucket) has a row per node, as it was first labelled, and is only added to;
    tombstones(old, survivor) leads each merged id to the one that stands. A component of the new edges over known clusters and new
    nodes takes the id of its oldest cluster (the least of equal age), or else of its least node; the other clusters'
    ids get tombstones. Members of known clusters are not read: a label is looked up for the ends of new edges only, in
    the buckets that these fall into. Loops label their node; a null end makes no edge.
    """
    fine = materialise(edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct(), "arrived")
    ends = fine.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("bucket", bucket())
    stands = looked_up(labels, ends).join(tombstones, F.col("cluster") == F.col("old"), "left")
    stands = stands.select("node", F.coalesce("survivor", "cluster").alias("cluster"), "born")
    known = materialise(ends.join(stands, "node", "left").select("node", "cluster", "born", "bucket"), "touched")
    # a cluster and a node may have one name, so each is marked
    mark = F.coalesce(F.concat(F.lit("c|"), F.col("cluster")), F.concat(F.lit("n|"), F.col("node")))
    named = known.select("node", mark.alias("at"))
    lifted = fine.join(named.select(F.col("node").alias("u"), F.col("at").alias("a")), "u").join(named.select(F.col("node").alias("v"), F.col("at").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(lifted)
    at = known.withColumn("at", mark).join(found.withColumnRenamed("node", "at"), "at", "left")
    placed = materialise(at.withColumn("root", F.coalesce("root", "at")), "placed")
    oldest = F.min(F.when(F.col("cluster").isNotNull(), F.struct("born", "cluster"))).alias("o")
    chosen = materialise(placed.groupBy("root").agg(oldest, F.min("node").alias("least")).select("root", F.coalesce("o.cluster", "least").alias("survivor"), F.coalesce("o.born", F.lit(batch)).alias("since")), "chosen")
    new = placed.filter("cluster IS NULL").join(chosen, "root").select("node", F.col("survivor").alias("cluster"), F.col("since").alias("born"), "bucket")
    merged = placed.filter("cluster IS NOT NULL").join(chosen, "root").filter("cluster <> survivor").select(F.col("cluster").alias("old"), "survivor").distinct()
    moved = tombstones.join(merged.select(F.col("old").alias("survivor"), F.col("survivor").alias("next")), "survivor", "left").select("old", F.coalesce("next", "survivor").alias("survivor"))
    added, standing = materialise(new, "labels_added"), materialise(moved.unionByName(merged), "tombstones")
    discard(fine, known, placed, chosen)
    return added, standing


def current(labels: DataFrame, tombstones: DataFrame) -> DataFrame:
    """node, cluster: every label with the cluster that stands for it now."""
    return labels.join(tombstones, F.col("cluster") == F.col("old"), "left").select("node", F.coalesce("survivor", "cluster").alias("cluster"))


def append_labels(added: DataFrame, path: str) -> None:
    """Put labels into the table at path, in a folder per bucket."""
    added.write.mode("append").partitionBy("bucket").parquet(path)


def saved(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """id, created_at, confidence, evidence, members for found(key, created_at, confidence, evidence, members) over stored clusters(id, created_at, confidence, evidence, members).

    A found cluster that overlaps stored ones becomes the oldest of them (the least id of equal age) with all their
    members; its confidence is the greater of both if it overlaps exactly one, and else its own. evidence is a
    map of feature to members, of which the greater count stays. Stored clusters without overlap stay as
    they are. Overlap is direct, as found clusters are components already; found(key) without overlap is stored under its key.
    """
    each = found.select("key", F.explode("members").alias("m")).join(clusters.select("id", F.explode("members").alias("m")), "m").select("key", "id").distinct()
    met = each.join(clusters.withColumnsRenamed({"confidence": "had", "evidence": "told", "members": "holds"}), "id")
    joined = met.groupBy("key").agg(F.min(F.struct("created_at", "id")).alias("o"), F.min_by("told", F.struct("created_at", "id")).alias("told"), F.count(F.lit(1)).alias("n"), F.max("had").alias("had"), F.flatten(F.collect_list("holds")).alias("holds"))
    out = found.join(joined, "key", "left")
    kind = dict(found.dtypes)["evidence"]
    none = F.create_map().cast(kind)
    evidence = F.map_zip_with(F.coalesce("told", none), F.coalesce("evidence", none), lambda k, a, b: F.greatest(a, b))
    fresh = out.select(
        F.coalesce("o.id", "key").alias("id"), F.coalesce("o.created_at", out["created_at"]).alias("created_at"), F.when(F.col("n") == 1, F.greatest("confidence", "had")).otherwise(F.col("confidence")).alias("confidence"), evidence.alias("evidence"),
        F.array_sort(F.array_distinct(F.concat("members", F.coalesce("holds", F.array().cast(dict(found.dtypes)["members"]))))).alias("members"))
    return fresh.unionByName(clusters.join(each.select("id").distinct(), "id", "left_anti").select("id", "created_at", "confidence", "evidence", "members"))
