"""Nested records held as VARIANT: merges of many updates, projection by path, absent fields, JSON-safe rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def fields(doc: Column) -> Column:
    """The members of a VARIANT object as a map; null for anything else."""
    return F.try_variant_get(doc, "$", _MAP)


def _variant(members: Column) -> Column:
    return F.parse_json(F.to_json(members))


def leaves(df: DataFrame, doc: str, depth: int) -> DataFrame:
    """df with path and value in place of doc: a row per leaf of each object, and one per object with a null at the end of its path.

    Leaves are numbers, texts, booleans, arrays, and whatever lies deeper than depth, taken whole. Null leaves are left
    out. A document that is no object has no rows.
    """
    rest = [c for c in df.columns if c != doc]
    row = lambda path, value: F.array(F.struct(path.alias("path"), value.alias("value")))
    none = F.lit(None).cast("string")

    def walk(path: Column, v: Column, level: int) -> Column:
        """The leaves of v as one array; an object is taken apart by one lookup, and what is none becomes a leaf."""
        leaf = row(path, F.when(~F.is_variant_null(v), F.to_json(v)))
        if level == depth:
            return leaf
        members = F.map_entries(fields(v))
        below = F.flatten(F.transform(members, lambda e: walk(F.array_append(path, e["key"]), e["value"], level + 1)))
        return F.coalesce(F.concat(row(F.array_append(path, none), F.lit("")), below), leaf)

    first = F.map_entries(fields(F.col(doc)))
    each = F.concat(row(F.array(none), F.lit("")), F.flatten(F.transform(first, lambda e: walk(F.array(e["key"]), e["value"], 1))))
    # the outer form, since Spark would evaluate the array once more to drop rows without any
    out = df.select(*rest, F.explode_outer(each).alias("x")).filter("x.value IS NOT NULL")
    return out.select(*rest, "x.path", F.when(F.element_at("x.path", -1).isNotNull(), F.col("x.value")).alias("value"))


def _written(entries: Column) -> Column:
    """JSON text of an object from its leaves, an array of (path, value) in any order; a path that ends in null opens an object."""
    name = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    depth = lambda path: F.greatest(F.size(path) - 1, F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        q, p = acc["at"], x["path"]
        width = F.least(depth(q), depth(p))
        same = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), width), lambda i: (i == width) | (F.get(q, i) != F.get(p, i)))), F.lit(0))
        closed = F.concat(acc["text"], F.repeat(F.lit("}"), depth(q) - same))
        comma = F.when(closed.endswith("{"), "").otherwise(",")
        opened = F.array_join(F.transform(F.slice(p, same + 1, depth(p) - same), lambda k: F.concat(name(k), F.lit(":{"))), "")
        last = F.element_at(p, -1)
        own = F.when(last.isNull(), "").otherwise(F.concat(name(last), F.lit(":"), x["value"]))
        more = F.concat(opened, own)
        return F.struct(p.alias("at"), F.concat(closed, F.when(more == "", "").otherwise(F.concat(comma, more))).alias("text"))

    # objects before what they hold: a null path element sorts first as the empty text of its level
    ordered = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(F.transform(e["path"], lambda k: F.concat(F.when(k.isNull(), "").otherwise(" "), F.coalesce(k, F.lit("")))).alias("key"), e["path"].alias("path"), e["value"].alias("value")))), lambda e: F.struct(e["path"], e["value"]))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit("{").alias("text"))
    return F.aggregate(ordered, start, add, lambda acc: F.concat(acc["text"], F.repeat(F.lit("}"), depth(acc["at"]) + 1)))


def merge(updates: DataFrame, keys: list[str], doc: str, order: list[str], depth: int = 8) -> DataFrame:
    """keys and doc: all updates of a key merged in their order, later leaves winning.

    Objects are merged member by member down to depth levels; deeper ones, arrays and scalars are taken whole. A null
    changes nothing. A later scalar replaces an object and a later object a scalar, with what stood there. A document
    that is no object counts as an empty one. Of equal order the greater text wins. depth 1 is the merge of plain maps.

    Updates are taken apart into leaves and summed by path, so a key with any number of updates shares the work of
    all tasks before its leaves, which are a row's worth, meet.
    """
    at = F.struct(*order).alias("at")
    rows = leaves(updates.select(*keys, at, F.col(doc).alias("doc")), "doc", depth)
    marker = F.element_at("path", -1).isNull()
    own = F.when(marker, F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path"))
    scalar, object_ = F.when(~marker, F.struct("at", "value")), F.when(marker, F.col("at"))
    nodes = rows.groupBy(*keys, own.alias("path")).agg(F.max(scalar).alias("s"), F.max(object_).alias("o"))
    listed = nodes.groupBy(*keys).agg(F.collect_list(F.struct("path", "s", "o")).alias("nodes"))
    listed = listed.withColumn("contested", F.filter("nodes", lambda n: n["s"].isNotNull() & n["o"].isNotNull()))
    time = lambda n: F.greatest(n["s"]["at"], n["o"])
    covered = lambda n: F.exists("contested", lambda c: (F.size(c["path"]) < F.size(n["path"])) & (F.slice(n["path"], 1, F.size(c["path"])) == c["path"]) & (c["s"]["at"] > time(n)))
    kept = F.filter("nodes", lambda n: ~covered(n))
    as_leaf = lambda n: n["s"].isNotNull() & (n["o"].isNull() | (n["s"]["at"] > n["o"]))
    entries = F.transform(kept, lambda n: F.struct(F.when(as_leaf(n), n["path"]).otherwise(F.array_append(n["path"], F.lit(None).cast("string"))).alias("path"), F.when(as_leaf(n), n["s"]["value"]).alias("value")))
    made = listed.select(*keys, F.parse_json(_written(entries)).alias(doc))
    every = updates.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [every[k].eqNullSafe(made[k]) for k in keys])
    return every.join(made, same, "left").select(*(every[k] for k in keys), F.coalesce(made[doc], F.parse_json(F.lit("{}"))).alias(doc))


def upsert(old: DataFrame, updates: DataFrame, keys: list[str], doc: str, order: list[str], depth: int = 8) -> DataFrame:
    """keys and doc: old(keys, doc) with updates(keys, doc, order) merged onto it as merge() does; keys that old lacks are inserted."""
    kinds = {f.name: f.dataType for f in updates.schema.fields}
    before = old.select(*keys, F.lit(0).alias("__turn"), *(F.lit(None).cast(kinds[c]).alias(c) for c in order), doc)
    after = updates.select(*keys, F.lit(1).alias("__turn"), *order, doc)
    return merge(before.unionByName(after), keys, doc, ["__turn", *order], depth)


def later_wins(first: Column, second: Column) -> Column:
    """Two VARIANT objects as one: members of second win, null members too; no object counts as an empty one."""
    a, b = (F.coalesce(fields(x), F.create_map().cast(_MAP)) for x in (first, second))
    return _variant(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)))


def _tree(paths: list[str]) -> dict:
    out: dict = {}
    for path in sorted(paths, key=lambda p: p.count("."), reverse=True):
        names = path.split(".")
        at = out
        for n in names[:-1]:
            at = at.setdefault(n, {})
        at[names[-1]] = None  # the whole member, whatever was named below it
    return out


def _pick(doc: Column, tree: dict, keep: bool) -> Column:
    """doc with only the members of tree, or without them."""
    members, whole, inner = fields(doc), [k for k, v in tree.items() if v is None], {k: v for k, v in tree.items() if v is not None}
    named = lambda k, names: k.isin(names) if names else F.lit(False)
    chosen = F.map_filter(members, lambda k, v: named(k, list(tree)) if keep else ~named(k, whole))

    def below(k: Column, v: Column) -> Column:
        out = None
        for name, sub in inner.items():
            out = F.when(k == name, _pick(v, sub, keep)) if out is None else out.when(k == name, _pick(v, sub, keep))
        return v if out is None else out.otherwise(v)

    made = F.transform_values(chosen, below)
    made = F.map_filter(made, lambda k, v: v.isNotNull())
    return F.when(members.isNotNull(), _variant(made)).otherwise(F.lit(None).cast("variant") if keep else doc)


def project(doc: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """A VARIANT object with only, or without, the members at these dotted paths; one of both is given.

    An object on the way to an included path stays, with that member alone, and is empty if it lacks it; a scalar on
    the way does not. Excluding a path below a scalar changes nothing. Arrays are members as a whole.
    """
    if (include is None) == (exclude is None):
        raise ValueError("give paths to include or paths to exclude")
    return _pick(doc, _tree(include if include is not None else exclude), include is not None)


def value_at(doc: Column, path: str, kind: str = "variant") -> Column:
    """What lies at a dotted path, as a type; null where it is missing or of another type."""
    return F.try_variant_get(doc, "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path.split(".")), kind)


def absent(doc: Column, path: str) -> Column:
    """Whether nothing lies at a dotted path; a null that is written there is something."""
    return value_at(doc, path).isNull()


def json_safe(df: DataFrame, name: str = "json") -> DataFrame:
    """One column of JSON texts, a row each: times in ISO form, bytes null, null fields kept, decimals and dates as text."""
    safe = {"binary": lambda c: F.lit(None).cast("string"), "date": lambda c: F.col(c).cast("string"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")}
    cells = [safe.get(t, lambda c, t=t: F.col(c).cast("string") if t.startswith("decimal") else F.col(c))(c).alias(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias(name))


def provider_answers(assets: DataFrame, runs: DataFrame, key: str = "id", doc: str = "record") -> DataFrame:
    """key, doc, sources: assets(key, doc, sources) after runs(key, provider, ok, at, summary, the last a VARIANT).

    A run that is ok and names an asset sets enrichment.<provider> to its summary with _fetched_at, in place of what
    stood there, and adds the provider to the sources; the latest run of a provider counts. Other runs change nothing.
    """
    fine = runs.filter(F.col("ok") & F.col(key).isNotNull()).join(assets.select(key), key, "left_semi")
    answer = later_wins(F.col("summary"), F.parse_json(F.to_json(F.struct(F.col("at").alias("_fetched_at")))))
    nested = _variant(F.create_map(F.lit("enrichment"), F.create_map(F.col("provider"), answer)))
    updates = fine.select(key, "at", nested.alias(doc))
    merged = upsert(assets.select(key, doc), updates, [key], doc, ["at"], depth=2)
    added = fine.groupBy(key).agg(F.array_sort(F.collect_set("provider")).alias("__new"))
    out = merged.join(assets.select(key, "sources"), key).join(added, key, "left")
    return out.select(key, doc, F.array_sort(F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("__new", F.array().cast("array<string>")))).alias("sources"))
