"""Session helpers: a default session, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # most rows that `small` sends to every executor

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(name: str = "cadenza", **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; cluster sizes stay with the caller."""
    b = SparkSession.builder.appName(name)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that setting is absent, a temporary folder is used in plain local mode only: on a cluster
    the executors would not see it, so there its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: the lineage ends at files that outlive executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cadenza_path = path
    _written.append(path)
    return out


_written: list[str] = []


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that `written` has made in this process. Results that still read them must have been stored before."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that `written` made; nothing that reads it may be run any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._cadenza_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(spark: SparkSession, rows: list[tuple], schema: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows made on the driver as a table, with a broadcast hint only while they number at most `most`; beyond it joins shuffle."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
