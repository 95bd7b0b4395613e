"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.spark import discard, materialise  # noqa: F401  (the operators take it from here)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that the line and word contracts name: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the quick path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that name a row by id and text; never null. Rows equal in both are one row repeated."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit("")))))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows that a task hands to Python at once, and bytes of text that Python works on at once (one text at least).
BATCH_ROWS, PART_BYTES = 1000, 1 << 20


def texts_in_small_batches(docs: DataFrame) -> DataFrame:
    """docs itself. Its session hands at most BATCH_ROWS rows to Python at once from now on, unless the user chose a number other than Spark's 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(key, "10000") == "10000":
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))
    return docs


def parts(batch: pa.RecordBatch, at: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most so many rows and PART_BYTES of the text column at, or of one longer text."""
    size = batch.column(at).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    ends = pa.compute.binary_length(size).to_numpy().cumsum()
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(ends.searchsorted(before + PART_BYTES, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi
