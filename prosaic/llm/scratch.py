"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. A session that runs on one machine
(master ``local``) may leave it unset, as tests do; on a cluster that is an
error, since executors can't share a folder of one machine.

What an operator saves is read by its lazy result, so it is deleted only when
told: at the end of the ``scope`` it was made in, or else by ``release``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made in no scope.
_loose: list[str] = []
_made: ContextVar[list[str]] = ContextVar("made", default=_loose)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; the session's own setting always wins."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


class Scratch:
    """A folder for one call of an operator; it is deleted with the scope it was made in, or by release()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _made.get().append(self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again: what follows doesn't recompute it, even when executors are lost."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables saved within are deleted at the end, and no others: results must have been written by then."""
    own: list[str] = []
    token = _made.set(own)
    try:
        yield
    finally:
        _made.reset(token)
        for path in own:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes the tables saved in no scope. Only for when every result that reads them has been written."""
    while _loose:
        delete(spark, _loose.pop())


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most that many rows, so that a worker's memory follows the length of texts, not of tables.

    Spark reads the setting when a query runs, so it stays with the session; a smaller one is left as it is.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
