"""Sharding by histogram sort.

Rows are ordered by a key of 32 hex digits: the hash of the text, then the id, so equal texts lie together.
Splitters that cut the order into ranges of equal bytes are found by iteration: exact bytes are counted
below all candidate boundaries that share the digits known so far, and the candidates around each target
are refined by three more digits, until every splitter meets the tolerance. Only counts reach the driver,
at most 4096 for each open splitter. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import materialise

SHARDS = 24
#: Ranges per shard. They are the tasks of the final exchange; a shard is a run of them.
CELLS = 8
#: A splitter is good when the bytes below it are this near its target, as a share of one range.
TOLERANCE = 0.002
DIGITS, STEP = 32, 3


def sort_key(doc_id: Column, text: Column) -> Column:
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    flipped = F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))
    return F.concat(hexed(F.xxhash64(F.coalesce(text, F.lit("")))), hexed(flipped))


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def splitters(keyed: DataFrame, ranges: int, tolerance: float = TOLERANCE) -> list[str]:
    """ranges - 1 ascending key prefixes for keyed(key, size); range i has the keys from splitter i - 1 up to below splitter i.

    A prefix compares as a string with whole keys. Fewer distinct boundaries than asked for (few rows, one
    key repeated) leave ranges empty. No rows: no splitters.
    """
    total = keyed.agg(F.sum("size")).first()[0]
    if not total:
        return []
    slack = total / ranges * tolerance
    done: dict[int, str] = {}
    # A target is open below a prefix: bytes before the prefix, and the targets that lie inside it.
    opened: dict[str, tuple[int, list[int]]] = {"": (0, list(range(1, ranges)))}
    for digits in range(STEP, DIGITS + STEP, STEP):
        inside = F.substring("key", 1, digits - STEP).isin(list(opened)) if digits > STEP else F.lit(True)
        counted = keyed.filter(inside).groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("b"), (F.min("key") == F.max("key")).alias("one")).collect()
        children: dict[str, list[tuple[str, int]]] = {}
        whole = {r.p for r in counted if r.one}  # a single key, which no boundary divides
        for p, b in sorted((r.p, r.b) for r in counted):
            children.setdefault(p[: digits - STEP], []).append((p, b))
        following: dict[str, tuple[int, list[int]]] = {}
        for prefix, (before, targets) in opened.items():
            below, todo = before, list(targets)
            for p, b in children[prefix]:
                while todo and total * todo[0] / ranges <= below + slack:
                    done[todo.pop(0)] = p
                here = [t for t in todo if total * t / ranges < below + b - slack]
                todo = todo[len(here) :]
                if here and p not in whole:
                    following[p] = (below, here)
                else:
                    done |= dict.fromkeys(here, p)
                below += b
            done |= dict.fromkeys(todo, _after(children[prefix][-1][0]))
        opened = following
        if not opened:
            break
    return [done[t] for t in range(1, ranges)]


def _after(p: str) -> str:
    """The least string above all keys that begin with p."""
    return p + "G"


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size (long), law ('bytes'), shard (int) and slot (long, gapless from 0 in each shard).

    Law bytes: the shards' bytes are equal to the tolerance and one row. Equal texts share a shard unless a
    boundary falls within their group, which ids then divide. Rows of equal text and id share a key and
    are not divided. Null text has no bytes, null ids come first. An empty table gives none. Input columns
    with the names of results are replaced.
    """
    key, size = sort_key(F.col(id_col), F.col(text_col)), row_size(F.col(text_col))
    keyed = materialise(docs.select(key.alias("key"), size.alias("size")), "shard_keys")
    cuts = splitters(keyed, shards * cells)
    cell = lambda k: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= k)) if cuts else F.lit(0)
    counts = keyed.groupBy(cell(F.col("key")).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(F.floor(F.col("__cell") / cells)).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))  # at most shards * cells rows
    out = docs.withColumns({"__key": key, "size": size}).withColumn("__cell", cell(F.col("__key"))).join(F.broadcast(starts), "__cell")
    place = F.row_number().over(W.partitionBy("__cell").orderBy("__key")) - 1
    return out.withColumns({"law": F.lit("bytes"), "shard": F.floor(F.col("__cell") / cells).cast("int"), "slot": (place + F.col("__start")).cast("long")}).drop("__key", "__cell", "__start")
