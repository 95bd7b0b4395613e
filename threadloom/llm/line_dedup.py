"""Line dedup: explode normalised lines, hash them, count documents per hash, drop what is too common, reassemble by position.

Only hashes and positions are exploded; of the texts themselves each is shuffled once, to meet its drop list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import BLANK, fold_ascii, let, materialise, row_key, unused

MIN_DOCS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return fold_ascii(F.btrim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (row_key), kept (positions that stay, ascending), n_dropped: one row per row that loses lines.

    A key of min_chars code points that min_docs documents have at least loses all its lines. Rows of one
    doc_id are one document, told by a 64-bit hash of the id; rows without an id are documents by their text.
    """
    short = lambda key: F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))
    keys = F.transform(_lines(F.col(text_col)), lambda line: let(line_key(line), short))
    document = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(0), text_col)).otherwise(F.xxhash64(id_col))
    hashed = materialise(docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), document.alias("document"), keys.alias("hs")), "line_keys")
    found = hashed.select("document", F.explode(F.array_distinct(F.array_compact("hs"))).alias("h")).groupBy("h")
    # counted by rows first, as that needs one row a task and hash; documents are told apart only where rows are enough
    several = materialise(found.agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_docs).select("h"), "frequent_lines")
    common = hashed.select("document", F.explode(F.array_distinct(F.array_compact("hs"))).alias("h")).join(several, "h").groupBy("h").agg(F.count_distinct("document").alias("c")).filter(F.col("c") >= min_docs).select("h")
    common = materialise(common, "common_lines")  # so the join can split the rows of a hot key
    at = hashed.select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h")).filter(F.col("h").isNotNull())
    gone = at.join(common, "h").groupBy("row").agg(F.max("n").alias("n"), F.collect_set("pos").alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "gone")
    return gone.select("row", kept.alias("kept"), F.size("gone").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text reassembled from the lines that stay, and n_lines and n_dropped (long).

    Null or empty text is one empty line and stays as it is. A text that loses all lines becomes empty.
    Input columns named n_lines or n_dropped are replaced; all others stay. An empty table gives none.
    """
    docs = docs.drop("n_lines", "n_dropped")
    row, stay, n = unused(docs, "row", "stay", "n")
    gone = dropped_lines(docs, min_docs, min_chars, id_col, text_col).select(F.col("row").alias(row), F.col("kept").alias(stay), F.col("n_dropped").alias(n))
    out = docs.join(gone, row_key(docs[id_col], docs[text_col]) == gone[row], "left")
    text, kept = F.col(text_col), F.col(stay)
    joined = let(_lines(text), lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    outputs = {"n_lines": F.size(_lines(text)).cast("long"), "n_dropped": F.coalesce(F.col(n), F.lit(0)).cast("long"), text_col: F.when(kept.isNull(), text).otherwise(joined)}
    return out.withColumns(outputs).drop(row, stay, n)
