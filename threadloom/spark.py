"""Session defaults and tables written to the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "threadloom", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, AQE, later map entries win, RocksDB for streams with state. Given settings go first."""
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    defaults["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    builder = SparkSession.builder.appName(name)
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset and Spark runs in this process (tests), a folder of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_threadloom_scratch", None)
    if own is None:
        own = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark._threadloom_scratch = own
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. Rows and columns are unchanged.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._threadloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for these tables. No unwritten result may depend on them any more."""
    for t in tables:
        spark, path = t.sparkSession, t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._threadloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
