"""Text, hash and cell functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(kind: Column, value: Column) -> Column:
    """Asset id: the first 24 hex digits of sha256 of type|value."""
    return F.substring(F.sha2(F.concat_ws("|", kind, value), 256), 1, 24)


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, relation, target), 256), 1, 24)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))


def shingles(items: Column, n: int) -> Column:
    """n-grams joined by a space; one of all items if there are fewer; none of none."""

    def grams(a: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.array_join(F.slice(a, i, n), " "))
        return F.when(F.size(a) == 0, F.array().cast("array<string>")).when(F.size(a) < n, F.array(F.array_join(a, " "))).otherwise(each)

    # a lambda over a one-element array evaluates items once, not for every gram
    return F.get(F.transform(F.array(items), grams), F.lit(0))


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def title_hash(title: Column) -> Column:
    known = normalize_title(title)
    return F.when(F.char_length(known) >= 3, F.sha1(known))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def string_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hex_bits(h: Column) -> Column:
    """A hash of up to 16 hex digits as a 64-bit integer; null if it is none."""
    return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("long"))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64 of two hex hashes; 0 if either is missing or malformed."""
    return F.coalesce(1 - F.bit_count(hex_bits(a).bitwiseXOR(hex_bits(b))) / 64.0, F.lit(0.0))


def refang(value: Column) -> Column:
    """Undo the usual defanging of an indicator: quotes and angle brackets, hxxp, bracketed dots and colons."""
    v = F.btrim(F.trim(value), F.lit("\"'<>"))
    v = F.regexp_replace(F.regexp_replace(v, "(?i)^hxxp", "http"), "(?i)^fxp", "ftp")
    v = F.regexp_replace(v, r"(?i)\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", ".")
    for shown, meant in (("[:]", ":"), ("[://]", "://"), ("[/]", "/")):
        v = F.replace(v, F.lit(shown), F.lit(meant))
    return v


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; null is empty."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)


def slug(name: Column, default: str = "report") -> Column:
    s = F.substring(F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9._-]+", "-"), F.lit("-")), 1, 80)
    return F.when(s == "", default).otherwise(s)


def mask_secret(secret: Column) -> Column:
    """Stars for up to eight characters, else the first and last four around stars."""
    n = F.char_length(secret)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(secret, -4, 4)))


def clean_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def last_n(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^\[|\]$", "")


# Public suffixes known here; under any other, a host is its own registrable domain.
SUFFIXES = ("com", "net", "org", "info", "biz", "io", "co", "dev", "app", "de", "fr", "es", "it", "nl", "ru", "cn", "in", "us", "uk", "co.uk", "org.uk", "com.au", "com.br", "co.jp")


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the longest known suffix, with it; the host itself, lower-cased, under no known suffix."""
    h = F.lower(host)
    out = h
    for s in sorted(suffixes, key=lambda s: s.count(".")):
        label = F.regexp_extract(h, r"([^.]+\." + s.replace(".", r"\.") + ")$", 1)
        out = F.when(label != "", label).otherwise(out)
    return out


def hosting_name(as_name: Column) -> Column:
    """The organisation of an AS name: what follows ' - ', without the country at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(as_name, r"^.*? - ", ""), r",\s*[A-Z]{2}$", ""))


def reversed_octets(ip: Column) -> Column:
    return F.array_join(F.reverse(F.split(ip, r"\.")), ".")


def short_issuer(name: Column) -> Column:
    """The organisation (O=) of a distinguished name, without quotes, or else its first 80 characters."""
    org = F.regexp_extract(name, r'(?:^|,\s*)O=("[^"]*"|[^,]*)', 1)
    return F.when(org != "", F.trim(F.btrim(org, F.lit('"')))).otherwise(F.substring(name, 1, 80))


def snapshot_time(digits: Column) -> Column:
    """yyyyMMddHHmmss as an ISO time; null if it is none."""
    return F.when(digits.rlike("^[0-9]{14}$"), F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", r"$1-$2-$3T$4:$5:$6Z"))


def quoted(term: Column) -> Column:
    """A search term in double quotes, with backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def html_escaped(value: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(c), F.lit(e))
    return value


def label(value: Column, most: int = 60) -> Column:
    """At most so many characters, the last three dots where it is cut."""
    return F.when(F.char_length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)


def time_ago(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days since."""
    out = F.when(seconds < 60, F.concat(F.greatest(seconds, F.lit(0)).cast("string"), F.lit("s ago")))
    for bound, unit, name in ((3600, 60, "m ago"), (86400, 3600, "h ago")):
        out = out.when(seconds < bound, F.concat(F.floor(seconds / unit).cast("string"), F.lit(name)))
    return out.otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))


def kind_of_id(value: Column, cluster_prefix: str = "CL-") -> Column:
    return F.when(value.startswith("inv_"), "investigation").when(value.startswith(cluster_prefix), "cluster").otherwise("asset")


def internal_host(host: Column) -> Column:
    """localhost, names under local, internal or lan, and private or loopback IPv4 addresses."""
    h = F.lower(host)
    return h.rlike(r"^localhost$|\.(local|internal|lan)$|^(10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^0\.0\.0\.0$")
