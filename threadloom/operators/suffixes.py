"""Registrable domains by a table of public suffixes, and what is filtered by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import SUFFIXES

# Registrable domains of platforms and infrastructure that say nothing about who operates a host.
KNOWN_INFRASTRUCTURE = (
    "google.com", "googleapis.com", "gstatic.com", "googletagmanager.com", "google-analytics.com", "cloudflare.com", "cloudflare.net", "amazonaws.com",
    "cloudfront.net", "akamai.net", "akamaiedge.net", "fastly.net", "azure.com", "microsoft.com", "windows.net", "office.com", "outlook.com", "apple.com",
    "icloud.com", "facebook.com", "fbcdn.net", "jsdelivr.net", "unpkg.com", "cdnjs.com", "github.io", "githubusercontent.com", "wordpress.com", "shopify.com",
    "wixsite.com", "squarespace.com", "zendesk.com", "gmail.com", "yahoo.com", "letsencrypt.org", "digicert.com", "sectigo.com", "godaddy.com",
    "domaincontrol.com", "awsdns-cn.com", "w3.org", "schema.org",
)


def rules(spark: SparkSession, lines: list[str] | DataFrame | None = None) -> DataFrame:
    """base, kind, labels from lines of a public-suffix list (or a table with a column rule); comments, blanks and repeats go.

    kind is plain, wildcard (*.base: any label before base is a suffix too) or exception (!base: not itself a suffix).
    Without lines the two dozen suffixes that the package knows.
    """
    if lines is None:
        lines = list(SUFFIXES)
    given = lines if isinstance(lines, DataFrame) else spark.createDataFrame([(x,) for x in lines], "rule string")
    rule = given.select(F.lower(F.regexp_extract("rule", r"^\s*(\S*)", 1)).alias("rule")).filter("rule <> '' AND NOT startswith(rule, '//')")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("plain")
    base = F.regexp_replace("rule", r"^(!|\*\.|\.)", "")
    return rule.select(base.alias("base"), kind.alias("kind")).distinct().withColumn("labels", F.size(F.split("base", r"\.")))


def registrable(hosts: DataFrame, suffixes: DataFrame, column: str = "host") -> DataFrame:
    """column, registrable for each distinct value of hosts: the public suffix of its name and the label before it.

    An exception decides before others, and else the longest suffix. A host that no rule knows, or that is a suffix
    itself, is its own registrable domain. Names are lower-cased and lose a final dot; null stays null.

    Every name meets the rules by an equi-join on each of its tails; Spark broadcasts the rules if they are small and
    shuffles both otherwise. Only distinct names are taken apart.
    """
    named = hosts.select(column).distinct().withColumn("__labels", F.split(F.regexp_replace(F.lower(column), r"\.$", ""), r"\."))
    tails = F.transform(F.sequence(F.lit(1), F.size("__labels")), lambda i: F.array_join(F.slice("__labels", i, F.size("__labels")), "."))
    each = named.select(column, F.col("__labels").alias("ls"), F.explode(tails).alias("base"))
    length = F.when(F.col("kind") == "wildcard", F.col("labels") + 1).when(F.col("kind") == "exception", F.col("labels") - 1).otherwise(F.col("labels"))
    met = each.join(suffixes, "base").withColumn("n", length).filter(F.col("n") <= F.size("ls"))
    best = met.groupBy(column).agg(F.max(F.struct((F.col("kind") == "exception").alias("e"), "n")).alias("m"))
    found = named.join(best, column, "left")
    whole, size = F.array_join("__labels", "."), F.size("__labels")
    out = F.when(F.col("m").isNull() | (F.col("m.n") >= size), whole).otherwise(F.array_join(F.slice("__labels", size - F.col("m.n"), F.col("m.n") + 1), "."))
    return found.select(column, F.when(F.col(column).isNotNull(), out).alias("registrable"))


def without_known(df: DataFrame, suffixes: DataFrame, column: str = "value", known: tuple[str, ...] = KNOWN_INFRASTRUCTURE) -> DataFrame:
    """df without rows whose name lies under one of the registrable domains known; null names stay."""
    found = registrable(df.select(column), suffixes, column).filter(F.col("registrable").isin(*known)).select(column)
    return df.join(found, column, "left_anti").select(df.columns)
