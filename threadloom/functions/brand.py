"""Brand assessment of a host and its page as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import registered_domain, string_similarity

# Letters that look like a Latin one, then spellings that stand for letters, in the order they are undone.
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g",
    "ӏ": "l", "ѕ": "s", "ԛ": "q", "ԝ": "w", "ν": "v", "ο": "o", "α": "a", "ı": "i", "ł": "l", "ø": "o",
}
LEET = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"), ("9", "g"), ("@", "a"), ("$", "s"))
# Words of a brand's name that tell nothing, and words that lure.
GENERIC = (
    "the", "and", "inc", "ltd", "llc", "corp", "group", "online", "official", "home", "welcome", "login", "sign", "secure", "page", "account", "services", "service", "www", "com", "net", "org",
)
PRIMARY_KEYWORDS = ("login", "signin", "verify", "authenticate", "support", "account", "secure", "portal", "update", "reset")
SECONDARY_KEYWORDS = (
    "sign-in", "log-in", "verification", "auth", "security", "password", "banking", "wallet", "confirm", "unlock", "recover", "billing", "invoice", "payment", "webmail", "sso", "2fa",
    "otp", "helpdesk", "service", "online", "customer", "access", "validate", "restore", "suspend",
)
SEPARATORS = (" | ", " - ", " – ", " — ", " :: ", ": ")


def _let(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@cache
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves in ASCII of a character: characters that leave one, and those that leave several."""
    each = ((c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) for c in map(chr, range(0x80, 0x110000)) if unicodedata.decomposition(c))
    left = {c: a for c, a in each if a}
    return {c: a for c, a in left.items() if len(a) == 1}, {c: a for c, a in left.items() if len(a) > 1}


@cache
def _prepared_away() -> str:
    """Characters that preparing a name for the DNS folds or composes into others, so that no name holds them."""
    return "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.normalize("NFKC", c.casefold()) != c)


def plain(text: Column) -> Column:
    """text in ASCII: characters that decompose to ASCII become that, accents and all others go."""
    single, several = _decompositions()
    letters = F.str_to_map(F.lit("\x01".join(f"{c}\x02{a}" for c, a in several.items())), F.lit("\x01"), F.lit("\x02"))  # folded to a constant
    spelt = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(letters, c), c)), "")
    wide = lambda t: F.when(t.rlike("[" + "".join(several) + "]"), spelt(t)).otherwise(t)
    left = lambda t: F.regexp_replace(_let(F.translate(t, "".join(single), "".join(single.values())), wide), r"[^\x00-\x7F]", "")
    return _let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), left(t)).otherwise(t))


def unicode_label(label: Column) -> Column:
    """The label that an xn-- label stands for (punycode, RFC 3492); other labels, and malformed ones, as they are.

    Malformed is also what stands for letters that name preparation folds, such as capitals and full-width forms.
    """
    coded = lambda l: F.coalesce(_let(_decoded(F.substring(F.lower(l), 5, 63)), lambda t: F.when(F.translate(t, _prepared_away(), "") == t, t)), l)
    return _let(label, lambda l: F.when(l.rlike("(?i)^xn--.*[a-z0-9]$"), coded(l)).otherwise(l))


def _decoded(body: Column) -> Column:
    """The letters of a punycode body, a fold over its digits; null if it is malformed. The letters so far are an array of code points."""
    digit = lambda c: F.when(c.rlike("^[a-z]$"), F.ascii(c) - 97).when(c.rlike("^[0-9]$"), F.ascii(c) - 22)
    digits = F.transform(F.split(F.regexp_extract(body, "([^-]*)$", 1), ""), digit)
    basic = F.regexp_extract(body, "^(.*)-", 1)
    state = lambda out, i, n, bias, old, w, k: F.struct(*(c.alias(x) for c, x in zip((out, i, n, bias, old, w, k), ("out", "i", "n", "bias", "old", "w", "k"), strict=True)))
    long = lambda n: F.lit(n).cast("long")
    whole = lambda c: F.floor(c).cast("long")
    codes = F.when(basic == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(basic, ""), lambda c: F.ascii(c).cast("long")))

    def adapted(delta: Column, count: Column, first: Column) -> Column:
        """The next bias: delta is scaled down until it is small; seven divisions by 35 do for any label."""
        begun = _let(whole(delta / F.when(first, 700).otherwise(2)), lambda d: d + whole(d / count))
        step = lambda s, _: F.when(s["d"] > 455, F.struct(whole(s["d"] / 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(begun.alias("d"), long(0).alias("k")), step, lambda s: s["k"] + whole(36 * s["d"] / (s["d"] + 38)))

    def placed(s: Column, i: Column) -> Column:
        """A number is complete: it tells the next letter and its place."""
        count = F.size(s["out"]).cast("long") + 1
        at, letter = i % count, s["n"] + whole(i / count)
        out = F.concat(F.slice(s["out"], F.lit(1), at.cast("int")), F.array(letter), F.slice(s["out"], (at + 1).cast("int"), count.cast("int")))
        return state(out, at + 1, letter, adapted(i - s["old"], count, s["old"] == 0), at + 1, long(1), long(36))

    def read(s: Column, d: Column) -> Column:
        least = F.least(F.greatest(s["k"] - s["bias"], F.lit(1)), F.lit(26))
        i = s["i"] + d * s["w"]
        # beyond a label's reach, or no digit: null, and null it stays
        more = lambda t: state(s["out"], t["i"], s["n"], s["bias"], s["old"], s["w"] * (36 - t["least"]), s["k"] + 36)
        return _let(F.struct(i.alias("i"), least.alias("least")), lambda t: F.when(t["i"] < 1 << 31, F.when(d < t["least"], placed(s, t["i"])).otherwise(more(t))))

    points = lambda s: F.when((s["k"] == 36) & (F.size(s["out"]) > 0) & F.forall(s["out"], lambda c: (c < 0x110000) & ~c.between(0xD800, 0xDFFF)), s["out"])
    out = F.aggregate(digits, state(codes, long(0), long(128), long(72), long(0), long(1), long(36)), read, points)
    return F.decode(F.unhex(F.array_join(F.transform(out, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "UTF-32")


def skeleton(label: Column) -> Column:
    """a-z that the label looks like: punycode is decoded, letters that look like Latin ones are told apart no more, accents go, then spellings are undone. Null is null."""
    out = F.translate(F.lower(unicode_label(label)), "".join(CONFUSABLES), "".join(CONFUSABLES.values()))
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), LEET, plain(out))
    return F.regexp_replace(out, "[^a-z]", "")


def brand_tokens(brand: Column) -> Column:
    """Words of three letters or digits or more that tell something; none of null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(brand, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*GENERIC))


def primary_token(brand: Column) -> Column:
    """The longest of brand_tokens(), the first of equals; null if there is none."""
    return F.aggregate(brand_tokens(brand), F.lit(""), lambda a, b: F.when(F.char_length(b) > F.char_length(a), b).otherwise(a), lambda x: F.when(x != "", x))


def _keywords(text: Column, words: tuple[str, ...]) -> Column:
    """How many of words text holds; null holds none."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.contains(text, F.lit(w)), F.lit(False)).cast("int") for w in words])


def infer_brand(site_name: Column, title: Column) -> Column:
    """The site's name from its metadata (64 characters, without a leading @), or else the shortest part of the title, between the first separator that gives one, without keywords."""
    clean = lambda p: (p != "") & (_keywords(F.lower(p), PRIMARY_KEYWORDS + SECONDARY_KEYWORDS) == 0)
    named = F.substring(F.trim(F.regexp_replace(site_name, "^@+", "")), 1, 64)
    options = [F.when(F.coalesce(site_name, F.lit("")) != "", named)]
    for sep in SEPARATORS:
        parts = F.filter(F.transform(F.split(title, sep.replace("|", r"\|")), F.trim), clean)
        shortest = F.get(F.array_sort(F.transform(parts, lambda p, i: F.struct(F.char_length(p).alias("n"), i.alias("i"), p.alias("p")))), F.lit(0))["p"]
        options.append(F.when(F.contains(title, F.lit(sep)), F.substring(shortest, 1, 64)))
    return F.coalesce(*options)


def mentions(text: Column, word: Column) -> Column:
    """How often word stands in text, without overlap."""
    t = F.coalesce(text, F.lit(""))
    return ((F.char_length(t) - F.char_length(F.replace(t, word))) / F.char_length(word)).cast("int")


def assess(host: Column, brand: Column, title: Column, text: Column, meta: Column, legitimate_domain: Column, logo_similarity: Column, login_form: Column, password_fields: Column,
           sensitive_fields: Column, external_action: Column, telegram: Column, active: Column, inferred: Column) -> Column:
    """struct(legitimate, similarity, impersonation), both scores 0 to 100 and 99, of a page that presents brand on host.

    legitimate_domain is the registrable domain of the brand, or null if none is known; flags and counts
    must not be null, texts may be. similarity sums domain (40 at most), content (35) and logo (25); to
    impersonation half of it counts, with harvesting, keywords and mismatch.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    h = F.lower(host)
    said = F.struct(h.alias("h"), low(title).alias("t"), low(text).alias("x"), low(meta).alias("m"), primary_token(brand).alias("token"), registered_domain(h).alias("registered"), F.lower(legitimate_domain).alias("own"))
    rest = (legitimate_domain, logo_similarity, login_form, password_fields, sensitive_fields, external_action, telegram, active, inferred)
    return _let(said, lambda s: _let(_names(s), lambda n: _scored(s, n, *rest)))


def _names(s: Column) -> Column:
    """struct(labels, looks, same): the labels of a host above its suffix, what they look like, and how alike its registrable domain and the brand's own look."""
    registered, h = s["registered"], s["h"]
    suffix = F.regexp_replace(registered, r"^[^.]+", "")  # with its dot; none under an unknown suffix
    bare = F.when(registered == h, F.regexp_replace(h, r"\.[^.]+$", "")).otherwise(F.substring(h, F.lit(1), F.char_length(h) - F.char_length(suffix)))
    head = lambda d: skeleton(F.regexp_extract(d, r"^([^.]+)", 1))
    same = _let(F.struct(head(registered).alias("a"), head(s["own"]).alias("b")), lambda p: string_similarity(p["a"], p["b"]))
    return _let(F.split(bare, r"\."), lambda labels: F.struct(labels.alias("labels"), F.transform(labels, skeleton).alias("looks"), F.coalesce(same, F.lit(0.0)).alias("same")))


def _scored(s: Column, n: Column, legitimate_domain: Column, logo_similarity: Column, login_form: Column, password_fields: Column, sensitive_fields: Column, external_action: Column, telegram: Column,
            active: Column, inferred: Column) -> Column:
    """The scores of assess() from what is said and how names look."""
    h, t, x, m, token, labels = s["h"], s["t"], s["x"], s["m"], s["token"], n["labels"]
    known = token.isNotNull()
    legitimate = F.coalesce(s["registered"] == s["own"], F.lit(False))
    in_domain = F.coalesce(F.contains(F.replace(F.array_join(labels, ""), F.lit("-"), F.lit("")), token), F.lit(False))
    looks = F.coalesce(F.contains(F.array_join(n["looks"], ""), token), F.lit(False))
    best = F.greatest(F.coalesce(F.array_max(F.transform(n["looks"], lambda w: string_similarity(w, token))), F.lit(0.0)), n["same"])
    domain = F.when(in_domain | looks, 40.0).when(known & (best >= 0.75), 30 * best).otherwise(0.0)
    in_title = F.coalesce(F.contains(t, token), F.lit(False))
    content = F.when(known, F.when(in_title, 20).otherwise(0) + F.least(F.lit(15), 3 * (mentions(x, token) + mentions(m, token)))).otherwise(0)
    logo = F.when(logo_similarity > 0.7, (logo_similarity - 0.7) / 0.3 * 25).otherwise(0.0)
    similarity = F.bround(F.least(F.lit(100.0), domain + content + logo)).cast("int")
    harvesting = sum((F.when(c, w).otherwise(0) for c, w in ((login_form, 15), (password_fields > 0, 10), (sensitive_fields >= 2, 5), (external_action, 10), (telegram, 15))), F.lit(0))
    keywords = F.least(F.lit(15), 5 * _keywords(h, PRIMARY_KEYWORDS + SECONDARY_KEYWORDS)) + F.least(F.lit(10), 3 * _keywords(F.concat(t, F.lit("\n"), x), PRIMARY_KEYWORDS))
    presents = known & ~legitimate & (in_title | (logo_similarity >= 0.85)) & (~in_domain | legitimate_domain.isNotNull())
    total = similarity * 0.5 + harvesting + keywords + F.when(presents, 10).otherwise(0)
    total = F.when(~known, (harvesting + keywords).cast("double")).when(inferred & in_domain & legitimate_domain.isNull(), (harvesting + keywords) * 0.5).otherwise(total)
    total = F.when(legitimate, 0.0).when(active, total).otherwise(total * 0.6)
    return F.struct(legitimate.alias("legitimate"), similarity.alias("similarity"), F.bround(F.least(F.lit(99.0), total)).cast("int").alias("impersonation"))
