"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the token windows of the documents.

Each n-gram has a 64-bit key made of the hashes of its words. Every window of a document is keyed alike and
looks its key up in the set, in a broadcast join; where a key is found, the words themselves are compared, so
every hit is verified. Windows that miss leave no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import LOWER, UPPER, let, materialise, row_key, unused

#: ASCII characters that are in no word: all but letters and digits. What is not ASCII is in words.
APART = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WINDOW = 10
#: The n-grams are broadcast up to this many bytes; beyond it the keys of both sides are shuffled, with the same result.
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. One translation and a split at spaces take half the time of a pattern for words."""
    plain = F.translate(F.coalesce(text, F.lit("")), APART + UPPER, " " * len(APART) + LOWER)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _key(hashes: Column, start: Column | int, size: int) -> Column:
    """The key of the window of size words from start on, from the hashes of the words."""
    return F.xxhash64(F.lit(size), *(F.get(hashes, F.lit(start) + F.lit(k)) for k in range(size)))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, w (words), item (its id as a string): one row per distinct window of each item.

    An item with fewer words than a window, but not none, is one window. Null text has none; items without
    an id have the id ''.
    """
    ws = F.explode(F.array(words(F.col("text"))))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), ws.alias("ws")).filter(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice("ws", i, size)))
    each = items.select("item", cut.alias("w")).distinct()
    key = F.lit(None).cast("long")
    for n in range(1, window + 1):
        key = F.when(F.size("w") == n, _key(_hashes(F.col("w")), 0, n)).otherwise(key)
    return each.select(key.alias("key"), "w", "item")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all, found), both from one pass over the texts. all: doc_id, row (row_key), n_words of each row.

    found: row, pos, n, item: each occurrence of a benchmark window of n words, at word pos, for each item that has it.
    """
    items = materialise(benchmark_windows(benchmark, window), "ngrams")
    grams = materialise(items.select("key", "w").distinct(), "grams")
    facts = grams.agg(F.sum(F.octet_length(F.array_join("w", " ")) + 60), F.collect_set(F.size("w"))).first()  # sizes: at most window numbers
    few = grams.withColumnRenamed("key", "gram")
    few = F.broadcast(few) if (facts[0] or 0) <= BROADCAST_BYTES else few
    # explode() of a one-element array keeps the words from being found twice
    texts = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.explode(F.array(words(F.col(text_col)))).alias("ws"))
    texts = texts.select("doc_id", "row", "ws", F.explode(F.array(_hashes(F.col("ws")))).alias("hs"))
    # place -1 stands for the row itself, so that its number of words comes from the same pass; its key is spread like any other
    met, own = None, [F.lit(-1)]
    for n in sorted(facts[1], reverse=True) or [window]:  # nearly always one size
        starts = F.when(F.size("hs") >= n, F.sequence(F.lit(-len(own)), F.size("hs") - n)).otherwise(F.array(*own).cast("array<int>"))
        at = texts.select("doc_id", "row", "ws", "hs", F.explode(starts).alias("pos"))
        # the key is computed after explode(), where it is compiled, and not in a lambda
        key = F.when(F.col("pos") < 0, F.xxhash64("row")).otherwise(_key(F.col("hs"), F.col("pos"), n))
        each = at.select("doc_id", "row", "ws", "pos", key.alias("key")).join(few, (F.col("key") == F.col("gram")) & (F.col("pos") >= 0), "left" if own else "inner")
        each = each.filter((F.col("pos") < 0) | (F.slice("ws", F.col("pos") + 1, F.lit(n)) == F.col("w")))
        each = each.select("doc_id", "row", "pos", F.lit(n).alias("n"), F.when(F.col("pos") < 0, F.size("ws")).cast("long").alias("n_words"), "key", "w")
        met, own = each if met is None else met.unionByName(each), []
    met = materialise(met, "occurrences")
    found = met.filter("pos >= 0").select("row", "pos", "n", "key", "w").distinct()
    return met.filter("pos < 0").select("doc_id", "row", "n_words"), found.join(items, ["key", "w"]).select("row", "pos", "n", "item")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all, hits). all: doc_id, row, n_words of each row; hits: row, n_hit, items (ids as strings, sorted), positions (of hit words) of rows with a hit."""
    base, found = occurrences(docs, benchmark, window, id_col, text_col)
    spread = found.select("row", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos")).groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    named = found.select("row", "item").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return base, spread.join(named, "row").select("row", F.size("positions").cast("long").alias("n_hit"), "items", "positions")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark window, or, with remove='spans', without the hit words.

    A removed word goes with what stands between it and the next word. Null and empty texts have no words
    and stay. An empty benchmark or table removes nothing. All columns are kept as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    row, at = unused(docs, "row", "at")
    hit = scan(docs, benchmark, window, id_col, text_col)[1].select(F.col("row").alias(row), F.col("positions").alias(at))
    same = row_key(docs[id_col], docs[text_col]) == hit[row]
    if remove == "documents":
        return docs.join(hit, same, "left_anti")
    # without a hit word the text stays; each piece is a word with what follows it
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(F.col(text_col), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)

    def rest(ps: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(ps) - 1), at)
        return F.concat(lead, F.array_join(F.transform(stay, lambda i: F.get(ps, i)), ""))

    out = docs.join(hit, same, "left")
    return out.withColumn(text_col, F.when(F.col(at).isNull(), F.col(text_col)).otherwise(let(pieces, rest))).drop(row, at)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), contaminated: one row per row of docs, contaminated or not."""
    base, hit = scan(docs, benchmark, window, id_col, text_col)
    out = base.join(hit.drop("positions"), "row", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
