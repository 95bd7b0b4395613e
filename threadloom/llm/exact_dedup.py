"""Exact dedup by a heavy-hitter split.

A frequent-items sketch (the mergeable relative of Misra-Gries that Spark ships as approx_top_k) finds
digests that may be frequent. Their groups are counted exactly by a pre-aggregated pass, and those winners,
at most HEAVY_LIMIT rows, are broadcast, so that the rows of hot groups are settled on the map side. The
digests that remain have only small groups and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import fold_ascii, materialise

#: Most digests that are broadcast: 256 rows of about 60 bytes.
HEAVY_LIMIT = 256
#: Counters of the sketch: a digest with more than about 1 in 3,000 rows cannot be missed.
TRACKED = 4096
#: A verified group of this many rows is heavy.
HEAVY_ROWS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the largest
    doc_id of the group, null only if all ids of it are null; kept is doc_id <=> keep_id, so rows that
    repeat a kept doc_id with the same text are kept alike, and each counts in group_size. An empty table
    gives an empty result. Other columns are ignored.
    """
    text = fold_ascii(F.coalesce(F.col(text_col), F.lit("")))
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    digests = digests.withColumn("h", F.xxhash64("digest"))
    found = digests.agg(F.expr(f"approx_top_k(h, {HEAVY_LIMIT}, {TRACKED})").alias("top")).select(F.filter("top", lambda t: t["count"] >= HEAVY_ROWS)["item"].alias("hs")).first()
    suspects = (found and found.hs) or []
    group = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = digests.filter(F.col("h").isin(suspects)).groupBy("digest").agg(*group).filter(F.col("group_size") >= HEAVY_ROWS)
    winners = F.broadcast(materialise(winners, "winners"))
    heavy = digests.join(winners, "digest")
    light = digests.join(winners.select("digest"), "digest", "left_anti")
    w = W.partitionBy("digest")
    light = light.withColumns({"keep_id": F.max("doc_id").over(w), "group_size": F.count(F.lit(1)).over(w)})
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns; rows without an id stay only if their group has no id."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256").distinct()
    digest = F.sha2(fold_ascii(F.coalesce(docs[text_col], F.lit(""))), 256)
    return docs.join(kept, docs[id_col].eqNullSafe(kept["doc_id"]) & (digest == kept["text_sha256"]), "left_semi")
