"""Lineage cuts that survive lost executors, and broadcasts behind a size check.

A cut writes a Parquet table below the folder that ``spark.checkpoint.dir``
names, so that every executor can read it again.  Only where that setting is
missing *and* the session runs in one local process is a temporary folder used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="folioforge-")
    return "file://" + _own[key]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` returned and nothing reads again."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        if p.startswith(shared_dir(spark)) or shared_dir(spark).removeprefix("file://") in p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` when a bounded count proves it has at most ``max_rows`` rows.

    The count stops at ``max_rows + 1`` rows.  Beyond it the frame is returned
    as it is, so that the join shuffles instead.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small
