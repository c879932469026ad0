"""Tables that operators write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session has none, a folder under /tmp is set for a master on this
    one machine; on a cluster that would lose rows, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file:///tmp/checkpoints/lumenvec"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: The folder of the innermost open ``scratch_scope``.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Everything that operators write while it is open goes when it closes.

    A result that was not written inside cannot be read afterwards.
    """
    path = fresh_path(spark, "scope")
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        remove(spark, path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the plans that run inside; put back after."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: While a table is written: shuffle files go with the step, and Arrow batches are bounded by bytes, as rows may be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


#: Rows of a task that sorts or folds rows of a few numbers, at about 100 bytes each and step.
TASK_ROWS = 500_000


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in as many tasks as so many rows take: tasks do not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


class Scratch:
    """The tables that an operator writes on its way, in the shared folder.

    A written table cuts the lineage: what reads it survives lost executors
    without the steps before.  Spark removes the shuffle files of a step once
    its table is written, and ``drop`` removes a table that later ones replace.
    What the operator's result still reads stays, for a scratch_scope to remove.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, fresh_path(spark, name)

    def store(self, step: str, df: DataFrame) -> DataFrame:
        with settings(self.spark, WRITING):
            df.write.parquet(f"{self.path}/{step}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{step}")

    def drop(self, *steps: str) -> None:
        for step in steps:
            remove(self.spark, f"{self.path}/{step}")
