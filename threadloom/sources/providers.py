"""Recorded provider payloads as facts: WHOIS text, routing text, certificate log, archive index, scan results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REDACTED = "(?i)redacted|privacy|not disclosed|withheld"


def _first(text: Column, names: str) -> Column:
    """The first value of a field that is not redacted."""
    values = F.regexp_extract_all(text, F.lit(rf"(?im)^\s*(?:{names})\s*:[ \t]*(\S[^\r\n]*?)\s*$"), F.lit(1))
    return F.get(F.filter(values, lambda v: ~v.rlike(REDACTED)), F.lit(0))


def whois(df: DataFrame, text: str = "text") -> DataFrame:
    """df with registrar, created, expires, organisation, nameservers (sorted, lower case), statuses and private."""
    t = F.col(text)
    servers = F.regexp_extract_all(t, F.lit(r"(?im)^\s*(?:name server|nserver)\s*:[ \t]*(\S+)"), F.lit(1))
    states = F.regexp_extract_all(t, F.lit(r"(?im)^\s*(?:domain )?status\s*:[ \t]*(\S+)"), F.lit(1))
    tidy = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: F.lower(F.rtrim(x, F.lit("."))))))
    return df.withColumns({
        "registrar": _first(t, "registrar|sponsoring registrar"), "created": _first(t, "creation date|created|registered on"), "expires": _first(t, "registry expiry date|expiry date|expires|registrar registration expiration date"),
        "organisation": _first(t, "registrant organi[sz]ation|org-name|orgname"), "nameservers": tidy(servers), "statuses": F.array_sort(F.array_distinct(states)), "private": t.rlike(REDACTED)})


def routing(df: DataFrame, text: str = "text") -> DataFrame:
    """df with asn (AS and a number), prefix, country, registry, allocated of a routing record 'asn | prefix | cc | registry | date'."""
    parts = F.transform(F.split(F.col(text), r"\|"), lambda x: F.trim(x))
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return df.withColumns({"asn": F.concat(F.lit("AS"), F.split_part(part(0), F.lit(" "), F.lit(1))), "prefix": part(1), "country": part(2), "registry": part(3), "allocated": part(4)})


def certificate_names(entries: DataFrame, newest: int = 300) -> DataFrame:
    """base, name, subdomain (else another name of a certificate): distinct names of the newest entries(base, id, name_value, not_before) of each base."""
    w = W.partitionBy("base").orderBy(F.desc("not_before"), F.desc("id"))
    kept = entries.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= newest)
    each = kept.select("base", F.explode(F.split("name_value", r"\s+")).alias("name")).select("base", F.lower(F.regexp_replace("name", r"^[*.]+", "")).alias("name"))
    return each.filter("name <> '' AND name <> base").distinct().withColumn("subdomain", F.endswith("name", F.concat(F.lit("."), F.col("base"))))


def certificate_summary(entries: DataFrame) -> DataFrame:
    """base, certificates, first_seen, last_seen, issuers (five most frequent, then by name)."""
    w = W.partitionBy("base").orderBy(F.desc("n"), "issuer")
    top = entries.groupBy("base", "issuer").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).filter("r <= 5")
    issuers = top.groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "issuer"))), lambda x: x["issuer"]).alias("issuers"))
    return entries.groupBy("base").agg(F.count(F.lit(1)).alias("certificates"), F.min("not_before").alias("first_seen"), F.max("not_before").alias("last_seen")).join(issuers, "base", "left")


def archive(snapshots: DataFrame) -> DataFrame:
    """url, snapshots, versions (distinct digests), first, last of an archive index(url, timestamp of 14 digits, digest)."""
    at = F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss"))
    return snapshots.groupBy("url").agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("digest").alias("versions"), F.min(at).alias("first"), F.max(at).alias("last"))


def scans(results: DataFrame) -> DataFrame:
    """target, scans, ips, asns, titles (sorted, distinct), first, last of scan results(target, ip, asn, title, at)."""
    distinct = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return results.groupBy("target").agg(F.count(F.lit(1)).alias("scans"), distinct("ip"), distinct("asn"), distinct("title"), F.min("at").alias("first"), F.max("at").alias("last"))


def indicators(lines: DataFrame, parse) -> DataFrame:
    """pos, raw, ioc: the first of equal indicators in lines(pos, raw), without blanks, comments and what parse (a struct of type and value) rejects."""
    tidy = lines.withColumn("raw", F.trim("raw")).filter("raw <> '' AND NOT startswith(raw, '#')").withColumn("ioc", parse(F.col("raw"))).filter("ioc.type IS NOT NULL")
    w = W.partitionBy("ioc.type", "ioc.value").orderBy("pos")
    return tidy.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def coalesced(payload: Column, *paths: str) -> Column:
    """The first JSON path that the payload has."""
    return reduce(F.coalesce, [F.get_json_object(payload, p) for p in paths])


def dns_summary(records: DataFrame) -> DataFrame:
    """host, a, aaaa, ips (both), cname, mx, ns, txt, has_mail: of records(host, rtype, value), values lower-cased but in txt, without the last dot, sorted, each once."""
    value = F.when(F.col("rtype") == "TXT", F.col("value")).otherwise(F.lower(F.regexp_replace("value", r"\.$", "")))
    each = records.withColumn("value", value)
    of = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("rtype").isin(*kinds), F.col("value"))))
    out = each.groupBy("host").agg(of("A").alias("a"), of("AAAA").alias("aaaa"), of("A", "AAAA").alias("ips"), of("CNAME").alias("cname"), of("MX").alias("mx"), of("NS").alias("ns"), of("TXT").alias("txt"))
    return out.withColumn("has_mail", F.size("mx") > 0)
