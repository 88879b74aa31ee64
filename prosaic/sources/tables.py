"""Tables that cut lineage: written once to the folder that all executors share, and read again.

``spark.checkpoint.dir`` names the folder. A session on one machine (master
``local``) may leave it unset, as tests do; on a cluster that is an error. The
tables are read by lazy results, so ``release`` deletes them when told.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which `release` deletes too."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables saved so far. Only for when every result that reads them has been written."""
    jvm = spark.sparkContext._jvm
    while _made:
        target = jvm.org.apache.hadoop.fs.Path(_made.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
