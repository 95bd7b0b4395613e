"""What a report says: its hosts and fingerprints, figures and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import HOST_TYPES, Scoring
from threadloom.operators.correlation import level


def hosts(assets: DataFrame, min_confidence: int = 0, most: int = 500) -> DataFrame:
    """The most hosts with min_confidence (null is 0), roots first, then by falling confidence, impersonation and id."""
    order = [F.desc(F.coalesce("is_root", F.lit(False))), F.desc(F.coalesce("confidence", F.lit(0))), F.desc(F.coalesce("impersonation_score", F.lit(0))), F.asc("id")]
    return assets.filter(F.col("type").isin(*HOST_TYPES) & (F.coalesce("confidence", F.lit(0)) >= min_confidence)).orderBy(*order).limit(most)


def fingerprints(assets: DataFrame) -> DataFrame:
    return assets.filter(~F.col("type").isin(*HOST_TYPES, "cluster"))


def stats(assets: DataFrame, found: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """section, name, n: assets by type, sites by status, the report's hosts by confidence level, and totals."""
    scoring = scoring or Scoring()
    count = F.count(F.lit(1)).cast("long").alias("n")
    by = lambda df, section, name: df.groupBy(name.alias("name")).agg(count).select(F.lit(section).alias("section"), "name", "n")
    high = dict(scoring.levels)["High"]
    totals = found.agg(F.count_if(F.coalesce("confidence", F.lit(0)) >= high).cast("long").alias("high_confidence"), F.coalesce(F.max("impersonation_score"), F.lit(0)).cast("long").alias("max_impersonation"))
    out = by(assets, "by_type", F.col("type"))
    out = out.unionByName(by(assets.filter(F.col("type").isin(*HOST_TYPES)), "site_status", F.coalesce("status", F.lit("UNKNOWN"))))
    out = out.unionByName(by(found.filter("confidence IS NOT NULL"), "confidence_levels", level(F.col("confidence"), scoring)))
    out = out.unionByName(assets.agg(count).select(F.lit("total").alias("section"), F.lit("assets").alias("name"), "n"))
    return out.unionByName(totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in totals.columns))).alias("x")).select(F.lit("total").alias("section"), "x.name", "x.n"))


def summary(figures: DataFrame) -> DataFrame:
    """line, text: the sentences of the summary from stats(); a sentence without anything to say is left out."""
    of = lambda section, *names: F.coalesce(F.sum(F.when((F.col("section") == section) & F.col("name").isin(*names), F.col("n"))), F.lit(0))
    one = figures.agg(
        of("total", "assets").alias("assets"), *(of("by_type", k).alias(k) for k in ("domain", "ip", "certificate", "favicon")), of("by_type", "analytics", "pixel", "tracking").alias("ids"),
        of("confidence_levels", "Very High", "High").alias("strong"), of("site_status", "ACTIVE").alias("active"))
    found = F.format_string("%d related assets were identified: %d domains, %d IP addresses, %d certificates, %d analytics/tracking IDs and %d favicons.", "assets", "domain", "ip", "certificate", "ids", "favicon")
    strong = F.when(F.col("strong") > 0, F.format_string("%d asset(s) are attributed to the same operation with High or Very High confidence.", "strong"))
    active = F.when(F.col("active") > 0, F.format_string("%d host(s) were ACTIVE at collection time and may warrant takedown or blocking.", "active"))
    return one.select(F.posexplode(F.array(found, strong, active)).alias("line", "text")).filter("text IS NOT NULL")


def best_entry(correlations: DataFrame) -> DataFrame:
    """host, investigation, score: of correlations(host, investigation, score) the greatest score of each host, the least investigation on a tie."""
    first = F.min_by(F.struct("investigation", "score"), F.struct(-F.col("score"), F.col("investigation")))
    return correlations.groupBy("host").agg(first.alias("b")).select("host", "b.investigation", "b.score")
