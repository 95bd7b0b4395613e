"""Inventory queries: filters, search, sort, pages, lookups, set updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTABLE = ("value", "type", "status", "confidence", "impersonation_score", "first_seen", "last_seen")


def search(df: DataFrame, q: str | None = None, columns: tuple[str, ...] = ("value",), types: tuple[str, ...] = (), statuses: tuple[str, ...] = (),
           min_confidence: int | None = None, since: int | None = None, until: int | None = None, member: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet every given condition. q is a literal, found in any case in any of columns (arrays: in an element).

    A null never meets a range. member maps array columns to a value that they must hold.
    """
    terms: list[Column] = []
    if q and q.strip():
        wanted = F.lit(q.strip().lower())
        kinds = dict(df.dtypes)
        each = [F.exists(c, lambda x: F.contains(F.lower(x), wanted)) if kinds[c].startswith("array") else F.contains(F.lower(F.col(c)), wanted) for c in columns]
        terms.append(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in each]))
    if types:
        terms.append(F.col("type").isin(*types))
    if statuses:
        terms.append(F.col("status").isin(*statuses))
    if min_confidence is not None:
        terms.append(F.col("confidence") >= min_confidence)
    if since is not None:
        terms.append(F.col("last_seen") >= since)
    if until is not None:
        terms.append(F.col("last_seen") <= until)
    terms += [F.array_contains(c, v) for c, v in (member or {}).items()]
    return reduce(lambda d, t: d.filter(t), terms, df)


def page(df: DataFrame, sort: str = "last_seen", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page, ids breaking ties; nulls sort lowest. number starts at 1, size lies between 1 and 500; other sort columns raise ValueError."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort!r}")
    number, size = max(1, number), min(500, max(1, size))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort)
    return df.orderBy(order, "id").offset((number - 1) * size).limit(size)


def by_fingerprint(prints: DataFrame, field: str, value: str, exclude: str | None = None) -> DataFrame:
    """Hosts of prints(host, field, value) with the value, without exclude."""
    out = prints.filter((F.col("field") == field) & (F.col("value") == value))
    return out if exclude is None else out.filter(F.col("host") != exclude)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among ids(id), each once."""
    one = edges.join(ids, edges.source == ids.id, "left_semi")
    return one.unionByName(edges.join(ids, edges.target == ids.id, "left_semi")).dropDuplicates(["id"])


def neighbours(assets: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, direction, type, other: the edges of ids(id) in and out, with the neighbour; neighbours that do not exist are dropped."""
    out = edges.select(F.col("source").alias("id"), F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
    into = edges.select(F.col("target").alias("id"), F.lit("in").alias("direction"), "type", F.col("source").alias("other"))
    known = assets.select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.col("value").alias("other_value"))
    return out.unionByName(into).join(ids, "id", "left_semi").join(known, "other")


def missing(ids: DataFrame, assets: DataFrame) -> DataFrame:
    """Those of ids(id) that no asset has; a link is valid if this is empty."""
    return ids.join(assets, "id", "left_anti")


def by_id(df: DataFrame, *ids: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows with these ids, with the given columns or all."""
    out = df.filter(F.col("id").isin(*ids))
    return out.select(*columns) if columns else out


def first_match(df: DataFrame, condition: Column, order: str = "id") -> DataFrame:
    """The row that meets the condition and is first by order; none if no row does."""
    return df.filter(condition).orderBy(order).limit(1)


def matching(df: DataFrame, condition: Column) -> DataFrame:
    """n: how many rows meet the condition. One row."""
    return df.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("n"))


def not_empty(column: str) -> Column:
    return F.size(F.coalesce(F.col(column), F.array())) > 0


def any_known(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def none_of(column: str, *values: str) -> Column:
    """Without these values; null passes."""
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def case_scope(assets: DataFrame, edges: DataFrame, case: DataFrame, clusters: DataFrame) -> DataFrame:
    """id: assets of case(kind, ref): named as asset, or member in clusters(cluster, host) of one named as cluster, or found by an investigation named there.

    Each asset once; what is named but does not exist is left out.
    """
    named = case.filter("kind = 'asset'").select(F.col("ref").alias("id"))
    grouped = clusters.join(case.filter("kind = 'cluster'").select(F.col("ref").alias("cluster")), "cluster", "left_semi").select(F.col("host").alias("id"))
    found = assets.select("id", F.explode("investigation_ids").alias("ref")).join(case.filter("kind = 'investigation'").select("ref"), "ref", "left_semi").select("id")
    return assets.select("id").join(named.unionByName(grouped).unionByName(found).distinct(), "id", "left_semi")
