"""Recorded answers of look-up services and web servers as facts: registry, reputation, host services, search hits, certificate pages, cookies, bodies.

Every function takes a DataFrame with a text column of recorded answers and adds columns; a null or malformed
answer gives null columns and no related entities. Input columns named as results are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOMAIN = r"^(?=.{1,253}$)(?:[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,63}|xn--[a-z0-9-]{2,59})$"
ADDRESS = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$|^(?=.*:)[0-9a-f:]{2,39}$"
RELATED = "array<struct<type:string,value:string,relation:string,reverse:boolean>>"


def _related(values: Column, kind: str, relation: str, reverse: bool = False, like: str | None = None) -> Column:
    """Distinct values, in order, as related entities; with like only those it matches. Null gives none."""
    kept = F.array_distinct(F.filter(values, lambda v: v.rlike(like) if like else v.isNotNull()))
    made = F.transform(kept, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(relation).alias("relation"), F.lit(reverse).alias("reverse")))
    return F.coalesce(made.cast(RELATED), F.array().cast(RELATED))


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v != "")))


def _tidy(value: Column) -> Column:
    return F.lower(F.rtrim(value, F.lit(".")))


# Registry answers

_CONTACT = "roles:array<string>,vcardArray:array<string>,publicIds:array<struct<type:string,identifier:string>>"


def _contact_type(levels: int) -> str:
    return f"struct<{_CONTACT}>" if levels == 1 else f"struct<{_CONTACT},entities:array<{_contact_type(levels - 1)}>>"


def _contacts(entities: Column, levels: int) -> Column:
    """Contacts at all levels, each before those within it."""
    none = F.array().cast(f"array<struct<{_CONTACT}>>")

    def opened(e: Column) -> Column:
        own = F.array(F.struct(*(e[c].alias(c) for c in ("roles", "vcardArray", "publicIds"))))
        return own if levels == 1 else F.concat(own, _contacts(e["entities"], levels - 1))

    return F.coalesce(F.flatten(F.transform(entities, opened)), none)


def _card(contact: Column, field: str) -> Column:
    """The first value of a card's field; a list is joined by spaces; null if it is empty."""
    items = F.from_json(F.get(contact["vcardArray"], F.lit(1)), "array<array<string>>")
    value = F.get(F.get(F.filter(items, lambda i: F.get(i, F.lit(0)) == field), F.lit(0)), F.lit(3))
    listed = F.array_join(F.filter(F.from_json(value, "array<string>"), lambda v: v != ""), " ")
    return F.nullif(F.when(F.startswith(value, F.lit("[")), listed).otherwise(value), F.lit(""))


def registry(df: DataFrame, payload: str = "payload", levels: int = 4) -> DataFrame:
    """df with handle, network, cidr, country, statuses, created, expires, updated, nameservers (sorted), signed, registrar, iana_id, registrant, abuse_email and related.

    Contacts may lie within contacts, to so many levels; of several with a role the last that has the value
    counts. The registrant is the organisation, else the name.
    """
    kind = f"struct<handle:string,name:string,country:string,status:array<string>,events:array<struct<eventAction:string,eventDate:string>>,nameservers:array<struct<ldhName:string>>,secureDNS:struct<delegationSigned:boolean>,cidr0_cidrs:array<struct<v4prefix:string,v6prefix:string,length:int>>,entities:array<{_contact_type(levels)}>>"
    p = F.from_json(F.col(payload), kind)
    at = lambda action: F.try_element_at(F.transform(F.filter(p["events"], lambda e: e["eventAction"] == action), lambda e: e["eventDate"]), F.lit(-1))
    out = df.withColumn("__people", F.transform(_contacts(p["entities"], levels), lambda c: F.struct(c["roles"].alias("roles"), c["publicIds"].alias("ids"), _card(c, "fn").alias("fn"), _card(c, "org").alias("org"), _card(c, "email").alias("email"))))
    last = lambda role, value: F.get(F.reverse(F.filter(F.transform(F.filter("__people", lambda c: F.array_contains(c["roles"], role)), value), lambda v: v.isNotNull())), F.lit(0))
    iana = lambda c: F.get(F.filter(c["ids"], lambda i: F.startswith(F.lower(i["type"]), F.lit("iana"))), F.lit(0))["identifier"]
    servers = _sorted(F.transform(p["nameservers"], lambda n: _tidy(n["ldhName"])))
    return out.withColumns({
        "handle": p["handle"], "network": p["name"], "country": p["country"], "statuses": p["status"], "created": at("registration"), "expires": at("expiration"), "updated": at("last changed"),
        "cidr": F.transform(p["cidr0_cidrs"], lambda c: F.concat_ws("/", F.coalesce(c["v4prefix"], c["v6prefix"]), c["length"].cast("string"))), "nameservers": servers, "signed": p["secureDNS"]["delegationSigned"],
        "registrar": last("registrar", lambda c: F.coalesce(c["fn"], c["org"])), "iana_id": last("registrar", iana), "registrant": last("registrant", lambda c: F.coalesce(c["org"], c["fn"])),
        "abuse_email": last("abuse", lambda c: c["email"]), "related": _related(servers, "nameserver", "USES_NAMESERVER", like=DOMAIN)}).drop("__people")


# Reputation


def abuse_reports(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with score, reports, reporters, last_reported, isp, usage, domain, country, tor, listed, hostnames and related: the domains that resolve to the address."""
    p = F.from_json(F.col(payload), "struct<data:struct<abuseConfidenceScore:int,totalReports:int,numDistinctUsers:int,lastReportedAt:string,isp:string,usageType:string,domain:string,countryCode:string,isTor:boolean,isWhitelisted:boolean,hostnames:array<string>>>")["data"]
    names = {"score": "abuseConfidenceScore", "reports": "totalReports", "reporters": "numDistinctUsers", "last_reported": "lastReportedAt", "isp": "isp", "usage": "usageType", "domain": "domain", "country": "countryCode", "tor": "isTor", "listed": "isWhitelisted", "hostnames": "hostnames"}
    return df.withColumns({**{k: p[v] for k, v in names.items()}, "related": _related(F.transform(p["hostnames"], F.lower), "domain", "RESOLVES_TO", True, DOMAIN)})


def noise(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with seen (noise or riot; false without an answer), noise, riot, classification, name, last_seen."""
    p = F.from_json(F.col(payload), "struct<noise:boolean,riot:boolean,classification:string,name:string,last_seen:string>")
    return df.withColumns({"seen": F.coalesce(p["noise"], F.lit(False)) | F.coalesce(p["riot"], F.lit(False)), **{k: p[k] for k in ("noise", "riot", "classification", "name", "last_seen")}})


def scanner_verdicts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with malicious, suspicious, harmless, undetected (0 if not told), reputation, tags, registrar, asn, owner, title, certificate, issuer, and related: addresses, nameservers and certificate."""
    kind = "struct<last_analysis_stats:struct<malicious:int,suspicious:int,harmless:int,undetected:int>,reputation:int,tags:array<string>,registrar:string,asn:long,as_owner:string,title:string,last_https_certificate:struct<thumbprint_sha256:string,issuer:struct<O:string>>,last_dns_records:array<struct<type:string,value:string>>>"
    p = F.from_json(F.get_json_object(payload, "$.data.attributes"), kind)
    of = lambda *types: F.transform(F.filter(p["last_dns_records"], lambda r: r["type"].isin(*types)), lambda r: _tidy(r["value"]))
    counts = {c: F.when(p.isNotNull(), F.coalesce(p["last_analysis_stats"][c], F.lit(0))) for c in ("malicious", "suspicious", "harmless", "undetected")}
    seal = F.lower(p["last_https_certificate"]["thumbprint_sha256"])
    related = F.concat(_related(of("A", "AAAA"), "ip", "RESOLVES_TO", like=ADDRESS), _related(of("NS"), "nameserver", "USES_NAMESERVER", like=DOMAIN), _related(F.array(seal), "certificate", "USES_CERTIFICATE"))
    return df.withColumns({**counts, "reputation": p["reputation"], "tags": p["tags"], "registrar": p["registrar"], "asn": p["asn"], "owner": p["as_owner"], "title": p["title"], "certificate": seal, "issuer": p["last_https_certificate"]["issuer"]["O"], "related": related})


# Hosts, certificates, search


def host_services(df: DataFrame, payload: str = "payload", services: int = 50, names: int = 100) -> DataFrame:
    """df with services (port, protocol, transport, software, certificate; the first so many), asn, owner, country, names (sorted, the first so many) and related.

    The record lies under result.resource, else under result. A service's certificate is that
    of its TLS leaf, else its own.
    """
    kind = "struct<services:array<struct<port:int,service_name:string,protocol:string,transport_protocol:string,software:array<struct<product:string>>,certificate:string,cert:struct<fingerprint_sha256:string>,tls:struct<certificates:struct<leaf_fp_sha_256:string,leaf_data:struct<fingerprint:string>>,fingerprint_sha256:string>>>,autonomous_system:struct<asn:long,name:string>,location:struct<country:string>,dns:struct<names:array<string>>>"
    p = F.from_json(F.coalesce(F.get_json_object(payload, "$.result.resource"), F.get_json_object(payload, "$.result")), kind)
    leaf = lambda s: F.coalesce(s["tls"]["certificates"]["leaf_fp_sha_256"], s["cert"]["fingerprint_sha256"])
    one = lambda s: F.struct(s["port"].alias("port"), F.coalesce(s["service_name"], s["protocol"]).alias("protocol"), s["transport_protocol"].alias("transport"), F.filter(F.transform(s["software"], lambda x: x["product"]), lambda x: x != "").alias("software"), F.lower(leaf(s)).alias("certificate"))
    found = F.transform(F.slice(p["services"], 1, services), one)
    named = F.slice(_sorted(F.filter(F.transform(p["dns"]["names"], F.lower), lambda n: n.rlike(DOMAIN))), 1, names)
    related = F.concat(_related(named, "domain", "RESOLVES_TO", True), _related(F.transform(found, lambda s: s["certificate"]), "certificate", "USES_CERTIFICATE"))
    return df.withColumns({"services": found, "asn": F.concat(F.lit("AS"), p["autonomous_system"]["asn"].cast("string")), "owner": p["autonomous_system"]["name"], "country": p["location"]["country"], "names": named, "related": related})


def search_hits(df: DataFrame, fields: list[str], relation: str, payload: str = "payload") -> DataFrame:
    """df with total, ips, titles (distinct, sorted) and related: the domains, hosts and addresses of the rows, which name their values in the order of fields."""
    p = F.from_json(F.col(payload), "struct<size:long,results:array<array<string>>>")
    column = lambda f: F.transform(p["results"], lambda r: F.get(r, F.lit(fields.index(f)))) if f in fields else F.array().cast("array<string>")
    host = F.transform(column("host"), lambda h: F.lower(F.split_part(F.try_element_at(F.split(h, "://"), F.lit(-1)), F.lit(":"), F.lit(1))))
    domains = F.concat(F.transform(column("domain"), F.lower), host)
    related = F.concat(_related(domains, "domain", relation, like=DOMAIN), _related(column("ip"), "ip", relation, like=ADDRESS))
    return df.withColumns({"total": p["size"], "ips": _sorted(column("ip")), "titles": _sorted(column("title")), "related": related})


def certificate_page(df: DataFrame, page: str = "page") -> DataFrame:
    """df with names (sorted, without wildcards), found, log_id and related: the domains that use the certificate of a log's page."""
    each = F.transform(F.regexp_extract_all(F.col(page), F.lit(r"DNS:([A-Za-z0-9*._-]+)"), F.lit(1)), lambda n: F.regexp_replace(F.lower(n), r"^[*.]+", ""))
    names = _sorted(each)
    return df.withColumns({"names": names, "found": F.coalesce(F.size(names) > 0, F.lit(False)), "log_id": F.nullif(F.regexp_extract(page, r"\?id=(\d+)", 1), F.lit("")), "related": _related(names, "domain", "USES_CERTIFICATE", True, DOMAIN)})


# Web answers


def cookies(headers: Column) -> Column:
    """array<struct<name, value, domain, path, secure, httponly, samesite>> of an array of Set-Cookie lines; a value's first 64 characters; lines without a name are left out."""

    def one(line: Column) -> Column:
        parts = F.transform(F.split(line, ";"), lambda x: F.trim(x))
        first, rest = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.size(parts))
        of = lambda key: F.get(F.transform(F.filter(rest, lambda x: F.startswith(F.lower(x), F.lit(key + "="))), lambda x: F.nullif(F.substr(x, F.lit(len(key) + 2)), F.lit(""))), F.lit(0))
        flag = lambda key: F.exists(rest, lambda x: F.lower(x) == key)
        value = F.regexp_replace(F.regexp_extract(first, r"^[^=]*=\s*(.*)$", 1), r'^"(.*)"$', "$1")
        return F.struct(F.trim(F.split_part(first, F.lit("="), F.lit(1))).alias("name"), F.substring(value, 1, 64).alias("value"), of("domain").alias("domain"), of("path").alias("path"), flag("secure").alias("secure"), flag("httponly").alias("httponly"), of("samesite").alias("samesite"))

    return F.filter(F.transform(headers, one), lambda c: c["name"] != "")


@F.pandas_udf(T.StringType())
def body_text(bodies: pd.Series, content_types: pd.Series) -> pd.Series:
    """Text of a body by the character set of its header, else of its markup, else as UTF-8, else as Latin-1; null stays null."""
    import re

    def one(body, kind):
        if body is None:
            return None
        named = re.search(r"charset=\s*[\"']?([\w-]+)", kind or "", re.I) or re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", body[:4096], re.I)
        known = named.group(1) if named else "utf-8"
        for name in (known.decode("ascii", "ignore") if isinstance(known, bytes) else known, "utf-8"):
            try:
                return body.decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
        return body.decode("latin-1")

    return pd.Series([one(b, k) for b, k in zip(bodies, content_types, strict=True)], dtype=object)
