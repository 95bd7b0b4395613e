"""Append sinks that leave one copy of a row, however often a batch is run again."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)


def write_batch(rows: DataFrame, batch: int, path: str, day: str = "day", key: str = "id") -> None:
    """Put one batch of rows(key, day, ...) into the table at path, in a folder per day and batch.

    Rows of one key are the same and become one. Keys that an earlier batch wrote on the same days are left out, for
    which only the key column of those days is read. The folders of this batch and its days are replaced, so a
    batch that ran before, or in part, leaves the same rows again; a null key is never equal to another.
    """
    spark = rows.sparkSession
    once = rows.filter(F.col(key).isNotNull()).dropDuplicates([day, key]).unionByName(rows.filter(F.col(key).isNull()))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        days = [r[0] for r in rows.select(day).distinct().limit(MOST_DAYS + 1).collect()]
        known = spark.read.parquet(path).filter(F.col("batch") != batch)
        known = known.filter(F.col(day).cast(kinds[day]).isin(days)) if len(days) <= MOST_DAYS else known
        once = once.join(known.select(F.col(day).cast(kinds[day]).alias(day), key), [day, key], "left_anti")
    once.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(path)


#: Days of a batch that are named to prune the table; a batch of more days reads the keys of all.
MOST_DAYS = 400


def append_once(stream: DataFrame, path: str, checkpoint: str, day: str = "day", key: str = "id") -> StreamingQuery:
    """Drain what is there of a stream into the table at path, as write_batch() does; a restart with the checkpoint goes on where it was."""
    each = lambda rows, batch: write_batch(rows, batch, path, day, key)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_audit(rows: DataFrame, path: str) -> bool:
    """Append audit rows(timestamp, username, action, ...) to path; False, with a log entry, if that fails, as auditing must not end the work that it records.

    id, status (success), details ({}) and day are filled in where rows lack them or have null.
    """
    try:
        given = {"status": F.lit("success"), "details": F.lit("{}"), "id": F.concat(F.lit("aud_"), F.expr("uuid()"))}
        for c, default in given.items():
            rows = rows.withColumn(c, F.coalesce(F.col(c), default) if c in rows.columns else default)
        rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)
    except (PySparkException, Py4JError):
        log.exception("audit rows were not written to %s", path)
        return False
    return True
