"""Indicator parsing, page structure and hashes that have no built-in form, as Arrow-batched functions over small standard-library helpers."""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# types as objects: text could not be parsed without a session, at import
IOC_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "value", "host", "url")])
LABEL = re.compile(r"^[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9])?$")
HASH = re.compile(r"^([0-9a-f]{40}|[0-9a-f]{64})$")


def domain(value: str) -> str | None:
    """Lower case, without a wildcard and final dots, in ASCII form; None if it is no domain name."""
    v = value.strip().lower().rstrip(".").removeprefix("*.")
    try:
        v = v if v.isascii() else v.encode("idna").decode()
    except UnicodeError:
        return None
    labels = v.split(".")
    fine = len(labels) > 1 and len(v) <= 253 and all(LABEL.match(x) for x in labels)
    return v if fine and re.match(r"^([a-z]{2,63}|xn--[a-z0-9-]{2,59})$", labels[-1]) else None


def address(value: str):
    try:
        return ipaddress.ip_address(value.strip("[]"))
    except ValueError:
        return None


def url(value: str) -> tuple[str, str] | None:
    """(url, host): lower-case scheme and host, no default port or fragment, path / if empty; None for what is not http(s)."""
    try:
        parts = urlsplit(value.strip())
        port = parts.port
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), (parts.hostname or "").rstrip(".")
    if scheme not in ("http", "https"):
        return None
    ip = address(host)
    host = str(ip) if ip else domain(host)
    if not host:
        return None
    shown = f"[{host}]" if ":" in host else host
    tail = "" if port in (None, {"http": 80, "https": 443}[scheme]) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{scheme}://{shown}{tail}{parts.path or '/'}{query}", host


def parse(value: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(type, value, host, url) of a refanged indicator: url, certificate hash, ip, host with a path, or domain; all None if it is none of these."""
    v = (value or "").strip()
    if "://" in v:
        found = url(v)
        return ("url", found[0], found[1], found[0]) if found else (None,) * 4
    bare = v.replace(":", "").lower()
    if HASH.match(bare):
        return "certificate", bare, None, None
    if ip := address(v):
        shown = f"[{ip}]" if ip.version == 6 else str(ip)
        return "ip", str(ip), str(ip), f"http://{shown}/"
    if "/" in v:
        found = url(f"http://{v}")
        return ("url", found[0], found[1], found[0]) if found else (None,) * 4
    name = domain(v)
    return ("domain", name, name, f"http://{name}/") if name else (None,) * 4


@F.pandas_udf(IOC_TYPE)
def parse_ioc(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(v) for v in values], columns=["type", "value", "host", "url"])


@F.pandas_udf(T.BooleanType())
def is_public_ip(values: pd.Series) -> pd.Series:
    return pd.Series([bool((a := address(v or "")) and a.is_global) for v in values])


def simhash_of(features: list[str]) -> str | None:
    """16 hex digits: each bit as most of the features' 8-byte blake2b digests have it; None without features."""
    if not len(features):
        return None
    digests = b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(0) * 2 > len(features)).tobytes().hex()


@F.pandas_udf(T.StringType())
def simhash(features: pd.Series) -> pd.Series:
    return pd.Series([None if f is None else simhash_of(list(f)) for f in features], dtype=object)


def murmur3(data: bytes, seed: int = 0) -> int:
    """Signed 32-bit MurmurHash3 (public domain, x86 variant)."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    whole = len(data) - len(data) % 4
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        h ^= turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = turn(h, 13) * 5 + 0xE6546B64 & mask
    if data[whole:]:
        h ^= turn(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@F.pandas_udf(T.IntegerType())
def favicon_hash(blobs: pd.Series) -> pd.Series:
    """The hash by which favicons are usually searched: murmur3 of the base64 text in lines of 76."""
    return pd.Series([None if b is None else murmur3(base64.encodebytes(bytes(b))) for b in blobs], dtype="Int32")


class _Page(HTMLParser):
    SKIP = ("hidden", "submit", "button", "image", "reset")

    def __init__(self):
        super().__init__()
        self.tags, self.forms, self.icons, self.images = [], [], [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if len(self.tags) < 5000:
            self.tags.append(".".join([tag, *sorted(a.get("class", "").split())[:3]]))
        if tag == "form" and len(self.forms) < 20:
            self.forms.append({"action": a.get("action", ""), "method": a.get("method", "get").lower(), "inputs": []})
        elif tag == "input" and self.forms and len(self.forms[-1]["inputs"]) < 50 and a.get("type", "text").lower() not in self.SKIP:
            self.forms[-1]["inputs"].append(f"{a.get('type', 'text').lower()}:{a.get('name', '')}")
        elif tag == "link" and "icon" in a.get("rel", "").lower() and a.get("href"):
            self.icons.append(a["href"])
        elif tag == "img" and a.get("src") and re.search("logo|brand|header-img|site-icon", " ".join(a.get(k, "") for k in ("src", "alt", "class", "id")), re.I):
            self.images.append(a["src"])


_FORM = T.StructType([T.StructField("action", T.StringType()), T.StructField("method", T.StringType()), T.StructField("inputs", T.ArrayType(T.StringType()))])
PAGE_TYPE = T.StructType([T.StructField("structure", T.StringType()), T.StructField("forms", T.ArrayType(_FORM)), T.StructField("icons", T.ArrayType(T.StringType())), T.StructField("logos", T.ArrayType(T.StringType()))])


@F.pandas_udf(PAGE_TYPE)
def page_structure(pages: pd.Series) -> pd.DataFrame:
    """SimHash of 4-shingles of tags with classes, forms with their visible inputs, icon and logo addresses, in page order, each once."""
    out = []
    for html in pages:
        p = _Page()
        p.feed((html or "")[:2_000_000])
        grams = [" ".join(p.tags[i : i + 4]) for i in range(max(1, len(p.tags) - 3))] if p.tags else []
        out.append((simhash_of(grams), p.forms, list(dict.fromkeys(p.icons)), list(dict.fromkeys(p.images))[:5]))
    return pd.DataFrame(out, columns=["structure", "forms", "icons", "logos"])
