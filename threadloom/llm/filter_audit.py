"""What each of several filters removes in every order, alone and on average (Shapley), by part of a corpus.

Documents are counted by part and by mask, the set of filters that they fail. For a part with c(m) documents of
mask m, the documents that a set of filters removes are the value at that set's corner of a polynomial, linear in
every variable: the sum over m of c(m) * (1 - product over i in m of (1 - x_i)). Corners give survivors, removals
and overlaps of every order; a filter's Shapley value is the integral, along the diagonal from 0 to 1, of the
partial derivative for its variable. Integrals are exact rationals; times the number of orders they are whole.

Only the counts by part and mask reach Python, at most 2^k rows of a part in a task of their own.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import UPPER, discard, materialise

#: More filters than this would have more orders than a report can list.
MOST = 6


class Removal:
    """The removal polynomial of weights by mask: coefficients of the products of variables, keyed by set of filters."""

    def __init__(self, weights: dict[frozenset[int], int]):
        self.terms: dict[frozenset[int], int] = {}
        for mask, w in weights.items():
            for r in range(1, len(mask) + 1):
                for s in combinations(sorted(mask), r):  # 1 - prod(1 - x) over the mask, multiplied out
                    self.terms[frozenset(s)] = self.terms.get(frozenset(s), 0) + (w if r % 2 else -w)

    def corner(self, filters) -> int:
        """Its value where the variables of filters are 1 and all others 0: what these filters remove together."""
        at = frozenset(filters)
        return sum(a for s, a in self.terms.items() if s <= at)

    def shapley(self, i: int) -> Fraction:
        """The integral of the derivative for variable i along the diagonal: a term of n variables becomes t^(n-1), and that 1/n."""
        return sum((Fraction(a, len(s)) for s, a in self.terms.items() if i in s), Fraction(0))


def orders(names: str, total: int, docs: dict, good: dict, toxic: dict):
    """A row for each order of the filters and step in it, from the counts by mask: see report()."""
    k, everything = len(names), range(len(names))
    removal, lost_good, lost_toxic = Removal(docs), Removal(good), Removal(toxic)
    corner = {frozenset(s): tuple(p.corner(s) for p in (removal, lost_good, lost_toxic)) for r in range(k + 1) for s in combinations(everything, r)}
    whole, shares = frozenset(everything), []
    for i in everything:
        share = removal.shapley(i) * factorial(k)
        assert share.denominator == 1
        shares.append(share.numerator)
    for order in permutations(everything):
        before = frozenset()
        for step, i in enumerate(order, 1):
            after = before | {i}
            gone, good_gone, toxic_gone = (b - a for a, b in zip(corner[before], corner[after], strict=True))
            redundant = corner[frozenset([i])][0] - gone
            unique = corner[whole][0] - corner[whole - {i}][0]
            yield "".join(names[j] for j in order), step, total - corner[after][0], gone, redundant, unique, good_gone, toxic_gone, shares[i]
            before = after


def words(text: Column) -> Column:
    """The words of text, as they are: maximal runs without the white space [\\x20\\x09-\\x0D]."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " ", -1), "")


def failures(text: Column, ws: Column) -> dict[str, Column]:
    """The failure conditions of a text with its words, by itself: A too short, B repetitive, C shouting, D holds one of the signs #$%&*|."""
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(ws) < 200,
        "B": 100 * F.size(F.array_distinct(ws)) < 50 * F.size(ws),
        "C": 100 * upper > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def counted(docs: DataFrame, labels: DataFrame, text_failures=failures, duplicate: str = "E", part_col: str = "source") -> tuple[str, DataFrame]:
    """The filters' letters, and part, mask, n, good, toxic: how many documents of each part fail exactly the filters of mask (bit i for letter i).

    text_failures gives conditions on a text and its words. duplicate names one more filter, which fails a document
    whose text is that of a smaller doc_id anywhere in the table. A null text is the empty one, a null part the
    empty string. A null doc_id has no label and is neither smaller nor larger than another; of a repeated row
    none is smaller. good and toxic count documents that labels has with quality 1 and with toxic 1 in any row.
    Other columns are not looked at; an empty table gives none.

    Texts are read once and leave a digest and a mask. Rows are summed by digest, part and labels before they are
    shuffled by digest, each sum with its least id and the rows that have it; the least id of all is joined to the
    sums. So a text that many rows share costs a row per task and part.
    """
    conditions = text_failures(F.col("text"), F.col("words"))
    names = "".join(conditions) + duplicate
    if len(set(names)) != len(conditions) + 1 or len(names) > MOST:
        raise ValueError(f"up to {MOST} filters, each named by a letter of its own: {names}")
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    text = F.coalesce(F.col("text"), F.lit(""))
    split_up = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), words(text).alias("words"))
    slim = split_up.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    rows = materialise(slim, "audited")
    one = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).cast("long")
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    keys = ["digest", "part", "mask", "good", "toxic"]
    per_id = rows.join(known, "id", "left").fillna(0, ["good", "toxic"]).groupBy("id", *keys).agg(F.count(F.lit(1)).alias("n"))
    summed = per_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("ids"), F.min("id").alias("least"), F.min_by("n", "id").alias("firsts"))
    least = summed.groupBy("digest").agg(F.min("least").alias("of_all"))
    late = F.col("ids") - F.when(F.col("least") == F.col("of_all"), F.col("firsts")).otherwise(0)
    split = summed.join(least, "digest").select("part", "mask", "good", "toxic", (F.col("n") - late).alias("first"), late.alias("late"))
    bit = 1 << len(conditions)
    each = split.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), F.col("late").alias("n"))))).filter("n > 0")
    out = each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    counts = materialise(out, "audit_counts")
    discard(rows)
    return names, counts


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part, order of the filters and step.

    Of each part's documents: kept after this step, removed by it, redundant (they fail its filter but were gone),
    unique_fails (they fail its filter alone), good_lost and toxic_lost (removed by it with that label), shapley
    (removed by its filter, summed over all orders). Options and the cases of nulls and repeats are those of counted().
    """
    names, counts = counted(docs, labels, **options)

    def part(rows):
        got = rows.to_pydict()
        masks = [frozenset(i for i in range(len(names)) if m >> i & 1) for m in got["mask"]]
        of = lambda c: dict(zip(masks, got[c], strict=True))
        made = [(got["part"][0], *x) for x in orders(names, sum(got["n"]), of("n"), of("good"), of("toxic"))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=columns)

    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return counts.groupBy("part").applyInArrow(part, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns[3:]))
