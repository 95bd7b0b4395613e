"""Features of web pages: trackers, technology, contacts, title, visible text; and the page verdict."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import registered_domain, url_host

# Tracker family, asset type, pattern (its first group that matched is the id), and words one of which the page must hold.
TRACKERS = [
    ("google_analytics", "analytics", r"\b(UA-\d{4,10}-\d{1,4})\b", ()),
    ("ga4", "analytics", r"\b(G-[A-Z0-9]{8,12})\b", ("gtag", "googletagmanager", "google-analytics", "ga4")),
    ("gtm", "tracking", r"\b(GTM-[A-Z0-9]{4,9})\b", ()),
    ("meta_pixel", "pixel", r"fbq\(\s*['\"]init['\"]\s*,\s*['\"](\d{10,20})['\"]|facebook\.com/tr\?id=(\d{10,20})", ()),
    ("linkedin_insight", "pixel", r"_linkedin_partner_id\s*=\s*['\"]?(\d{3,12})|px\.ads\.linkedin\.com/collect/?\?pid=(\d{3,12})", ()),
    ("tiktok_pixel", "pixel", r"ttq\.load\(\s*['\"]([A-Z0-9]{15,25})['\"]|analytics\.tiktok\.com/i18n/pixel/events\.js\?sdkid=([A-Z0-9]{15,25})", ()),
    ("google_adsense", "tracking", r"\b(ca-pub-\d{10,20})\b", ()),
    ("yandex_metrika", "tracking", r"ym\(\s*(\d{5,10})\s*,\s*['\"]init['\"]|mc\.yandex\.ru/watch/(\d{5,10})", ()),
    ("hotjar", "tracking", r"hjid\s*:\s*(\d{5,10})", ()),
    ("ms_clarity", "tracking", r"clarity\.ms/tag/([a-z0-9]{8,12})", ()),
]
# Technology and what gives it away.
TECHNOLOGIES = {
    "wordpress": r"wp-content|wp-includes", "jquery": r"jquery(?:\.min)?\.js", "react": r"react(?:-dom)?(?:\.production)?(?:\.min)?\.js|__NEXT_DATA__|data-reactroot",
    "bootstrap": r"bootstrap(?:\.min)?\.(?:css|js)", "cloudflare": r"cdn-cgi/|cf-ray|__cf_bm", "php": r"\.php\b",
}
# E-mail addresses and wallets in a page.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b"
WALLET = r"\b(?:bc1[a-z0-9]{25,60}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[a-fA-F0-9]{40}|T[A-Za-z1-9]{33})\b"
# Patterns and weights of a page that was taken down, is parked, or is inactive.
TAKEDOWN = [
    (r"this (?:domain|website|site) has been seized", 100), (r"domain (?:name )?(?:has been )?seized", 90),
    (r"seized by (?:the )?(?:federal bureau|fbi|europol|national crime agency|law enforcement)", 100),
    (r"this (?:account|website|site|page) (?:has been|is) (?:suspended|disabled|terminated|deactivated)", 80),
    (r"account (?:has been )?suspended", 60), (r"website (?:is )?(?:suspended|disabled|blocked)", 60),
    (r"(?:has been|was) (?:removed|taken down) (?:for|due to) (?:violat|abuse|phishing|fraud)", 90),
    (r"phishing (?:site|page|content) (?:has been )?(?:removed|blocked|disabled)", 90), (r"suspected phishing", 40),
    (r"violat(?:ed|ion of) (?:our|the) (?:terms|acceptable use|tos)", 50),
    (r"site (?:has been )?(?:removed|disabled) by (?:the )?(?:host|administrator|owner)", 60),
    (r"this site can.?t be reached due to (?:abuse|a policy)", 50),
    (r"the requested (?:site|page) has been (?:disabled|deleted)", 50), (r"\bclienthold\b|\bserverhold\b", 70),
]
PARKED = [
    (r"(?:this|the) domain (?:name )?(?:is|may be) for sale", 90), (r"buy this domain", 80), (r"domain (?:is )?parked", 80),
    (r"parked (?:free|domain|by|courtesy)", 70), (r"this domain (?:name )?(?:has been )?registered (?:at|by|with)", 40),
    (r"related (?:searches|links)", 30), (r"make an offer on this domain", 80),
    (r"\b(?:sedo|sedoparking|bodis|parkingcrew|above\.com|afternic|dan\.com|hugedomains|undeveloped|parklogic|domainmarket|namebright|uniregistry|godaddy\.com/domainsearch|smartname)\b", 50),
    (r"coming soon", 20), (r"under construction", 25), (r"future home of", 50), (r"website is (?:currently )?under maintenance", 15),
]
INACTIVE = [
    (r"\b404\b.{0,40}not found|not found.{0,40}\b404\b", 70), (r"page (?:not found|does not exist|cannot be found)", 60),
    (r"the requested url was not found", 70), (r"no such (?:site|app|bucket)", 70), (r"there is no (?:app|site) configured at that hostname", 80),
    (r"(?:repository|site) not found", 50), (r"\bdomain (?:has )?expired\b", 70), (r"this domain is not (?:configured|connected)", 70),
    (r"welcome to nginx!|it works!|apache2 (?:ubuntu|debian) default page|iis windows server|test page for the (?:nginx|apache)", 60),
    (r"default (?:web )?page", 30), (r"index of /", 20),
]

# What tells parked, held, taken-down and unreachable hosts.
PARKING_NAMESERVERS = r"(?i)sedoparking|parkingcrew|bodis|above\.com|parklogic|dan\.com|afternic|hugedomains|cashparking|domaincontrol\.com\.parked|parking|undeveloped|ztomy|park\."
MARKUP_TAKEDOWN = r"(?i)cgi-sys/suspendedpage|/suspended\.page|account-suspended"
MARKUP_PARKING = r"(?i)sedoparking\.com|parkingcrew\.net|bodis\.com|park\.above\.com|afternic\.com|dan\.com/|hugedomains\.com|parklogic\.com|img\.sedoparking|domainmarket\.com|cashparking"
HOLDS = ("clienthold", "serverhold", "redemptionperiod", "pendingdelete")
UNREACHED = r"(?i)refused|timed out|timeout|could not resolve|resolution failed|no route|unreachable"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _named(family: str, kind: str):
    return lambda i: F.struct(F.lit(family).alias("family"), F.lit(kind).alias("type"), i.alias("id"))


def trackers(html: Column) -> Column:
    """array<struct<family, type, id>>: each id once, under the first family that finds it, sorted by family and id."""
    each = []
    for family, kind, pattern, words in TRACKERS:
        ids = _all(html, pattern, 1)
        if pattern.count("|") and "(\\d" in pattern.partition("|")[2] or "sdkid" in pattern:
            ids = F.concat(ids, _all(html, pattern, 2))
        found = F.transform(F.array_distinct(F.filter(ids, lambda i: i != "")), _named(family, kind))
        if words:
            low = F.lower(html)
            seen = F.lit(False)
            for w in words:
                seen = seen | F.contains(low, F.lit(w))
            found = F.when(seen, found).otherwise(F.filter(found, lambda x: F.lit(False)))
        each.append(found)
    return F.array_sort(F.coalesce(F.concat(*each), F.array().cast("array<struct<family:string,type:string,id:string>>")))


def technologies(html: Column) -> Column:
    return F.array_compact(F.array(*(F.when(html.rlike(f"(?i){p}"), F.lit(t)) for t, p in sorted(TECHNOLOGIES.items()))))


def emails(html: Column, limit: int = 20) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.transform(_all(html, EMAIL), F.lower))), 1, limit)


def wallets(html: Column, limit: int = 10) -> Column:
    return F.slice(F.array_sort(F.array_distinct(_all(html, WALLET))), 1, limit)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles, templates, comments and tags, with single spaces; entities stay as written."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


# The meta entries that are kept.
META = ("description", "keywords", "generator", "author", "robots", "application-name", "og:title", "og:site_name", "og:description", "og:url", "og:image", "twitter:title", "twitter:site", "theme-color", "refresh")
# Redirects that a page asks for.
REFRESH = r"(?i)<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]*content=[\"']?\s*\d+\s*;\s*url=([^\"'>\s]+)"
SCRIPTED = r"(?i)(?:\blocation(?:\.href)?\s*=\s*|\blocation\.replace\()[\"']([^\"']+)[\"']"


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, without quotes; null if the tag has none."""
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.when(value != "", F.regexp_replace(value, "^[\"']|[\"']$", ""))


def _tags(html: Column, names: str) -> Column:
    return _all(html, rf"(?i)<(?:{names})\b[^>]*>")


def language(html: Column) -> Column:
    return attribute(F.regexp_extract(html, r"(?i)<html\b[^>]*>", 0), "lang")


def metadata(html: Column) -> Column:
    """map of the entries in META that the page has, by their last value, 500 characters at most; a null page has none."""
    key = lambda t: F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"), attribute(t, "http-equiv")))
    found = F.transform(_tags(html, "meta"), lambda t: F.struct(key(t).alias("k"), attribute(t, "content").alias("v")))
    last = F.transform(F.array(*map(F.lit, META)), lambda k: F.struct(k.alias("k"), F.try_element_at(F.filter(found, lambda m: (m["k"] == k) & (m["v"] != "")), F.lit(-1))["v"].alias("v")))
    return F.map_from_entries(F.transform(F.filter(last, lambda m: m["v"].isNotNull()), lambda m: F.struct(m["k"].alias("k"), F.substring(m["v"], 1, 500).alias("v"))))


def _hosts(tags: Column, name: str, url: Column) -> Column:
    """Hosts that an attribute of the tags leads to; that of the page for a relative one, none for other schemes."""
    def host(t: Column) -> Column:
        to = F.trim(attribute(t, name))
        to = F.when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to)).when(to.rlike(r"^(?i)https?://"), to).when(~to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        return url_host(to)

    return F.filter(F.transform(tags, host), lambda h: h != "")


def resource_hosts(html: Column, url: Column) -> Column:
    """struct<scripts, resources, external>: sorted hosts of scripts; of these, links, images, frames and anchors; and those under another registrable domain than url's."""
    scripts = _hosts(_tags(html, "script"), "src", url)
    both = F.concat(scripts, _hosts(_tags(html, "link|a"), "href", url), _hosts(_tags(html, "img|iframe"), "src", url))
    every = F.array_sort(F.array_distinct(both))
    base = registered_domain(url_host(url))
    return F.struct(F.array_sort(F.array_distinct(scripts)).alias("scripts"), every.alias("resources"), F.filter(every, lambda h: registered_domain(h) != base).alias("external"))


def redirect_hints(html: Column, limit: int = 20) -> Column:
    """struct<refresh, scripted>: where a refresh leads, null if there is none, and the sorted targets that scripts set, the first so many."""
    to = F.regexp_extract(html, REFRESH, 1)
    return F.struct(F.when(to != "", to).alias("refresh"), F.slice(F.array_sort(F.array_distinct(_all(html, SCRIPTED, 1))), 1, limit).alias("scripted"))


def _re2(pattern: str) -> str:
    """pattern for Java, read as RE2 does: words are of ASCII letters, digits and underscores (what Java's \\b takes for a letter depends on its version), and a dot is anything but a line feed.

    A \\b before a letter, a digit or a group begins a word, any other ends one.
    """
    word = "[0-9A-Za-z_]"
    return "(?d)" + re.sub(r"\\b", f"(?!{word})", re.sub(r"\\b(?=[0-9A-Za-z(])", f"(?<!{word})", pattern))


def _sum(text: Column, patterns) -> Column:
    total = F.lit(0)
    for p, w in patterns:
        total = total + F.when(text.rlike(_re2(p)), w).otherwise(0)
    return total


def verdict(pages: DataFrame, text: Column, status_code: Column, words: Column, login: Column, html: Column | None = None, fetch_error: Column | None = None,
            dns_resolves: Column | None = None, nameservers: Column | None = None, registry_status: Column | None = None) -> DataFrame:
    """pages with status, confidence and the three scores, by patterns in text (lower-cased here) and by status code.

    A registry hold, then a name that does not resolve, then a fetch error without a code decide at once. Else
    the best of takedown, parked and inactive, in this order at a tie, wins from 50 points on, with a
    confidence of 40 and half its score, 99 at most; else the code decides. A null status code decides nothing.
    Markup is searched in the first 100,000 characters of html, and a page of fewer than 8 words counts as
    an empty body if html is given and is null or empty. nameservers and registry_status are arrays.
    """
    no, given = F.lit(False), lambda c, f: F.lit(False) if c is None else F.coalesce(f(c), F.lit(False))
    markup = lambda pattern: given(html, lambda c: F.substring(c, 1, 100_000).rlike(pattern))
    named = given(nameservers, lambda c: F.exists(c, lambda x: F.coalesce(x.rlike(PARKING_NAMESERVERS), no)))
    held = given(registry_status, lambda c: F.exists(c, lambda x: F.coalesce(F.replace(F.lower(x), F.lit(" "), F.lit("")).isin(*HOLDS), no)))
    lost, failed = given(dns_resolves, lambda c: ~c), given(fetch_error, lambda c: c != "") & status_code.isNull()
    unreached = given(fetch_error, lambda c: c.rlike(UNREACHED))
    bare = no if html is None else (F.coalesce(html, F.lit("")) == "") & status_code.between(200, 299) & (words < 8) & ~login
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("i")))  # letter by letter; this one alone would become two
    seized = _sum(low, TAKEDOWN) + F.when(markup(MARKUP_TAKEDOWN), 90).otherwise(0)
    down = seized + F.when(status_code == 451, 80).when(status_code.isin(402, 403) & (seized > 0), 20).otherwise(0)
    parked = _sum(low, PARKED) + F.when(markup(MARKUP_PARKING), 60).otherwise(0) + F.when(named, 60).otherwise(0) - F.when(login, 60).otherwise(0)
    gone = _sum(low, INACTIVE) + F.when(status_code.isin(404, 410), 70).when(status_code >= 500, 30).otherwise(0) + F.when(bare, 40).otherwise(0) - F.when(login, 50).otherwise(0)
    first = lambda *x: F.when(held, x[0]).when(lost, x[1]).when(failed, F.when(named, x[2]).when(unreached, x[3]).otherwise(x[4]))
    scored = pages.withColumns({"takedown": down, "parked": F.greatest(parked, F.lit(0)), "inactive": F.greatest(gone, F.lit(0)), "__code": status_code, "__long": (words > 30) | login, "__status": first("TAKEDOWN", "INACTIVE", "PARKED", "INACTIVE", "ERROR"), "__sure": first(90, 85, 70, 70, 60)})
    best = F.greatest("takedown", "parked", "inactive")
    code = F.col("__code")
    status = (F.when(best >= 50, F.when(F.col("takedown") == best, "TAKEDOWN").when(F.col("parked") == best, "PARKED").otherwise("INACTIVE"))
        .when(code >= 500, "ERROR").when(code.between(200, 399), "ACTIVE").when(code.isin(401, 403), "ACTIVE").otherwise("ERROR"))
    sure = (F.when(best >= 50, F.least(F.lit(99), 40 + F.floor(best / 2).cast("int"))).when(code >= 500, 60)
        .when(code.between(200, 399), F.when(F.col("__long"), 70).otherwise(55)).when(code.isin(401, 403), 45).otherwise(40))
    status, sure = F.coalesce("__status", status), F.coalesce("__sure", sure)
    return scored.withColumns({"status": status, "confidence": sure}).drop("__code", "__long", "__status", "__sure")
