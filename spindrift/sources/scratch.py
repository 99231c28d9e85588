"""Scratch tables: cuts in the lineage that survive lost executors, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold while a scratch table is written: Arrow batches are bounded by bytes, as rows of very long texts must
#: not pile up by the row count alone, and shuffle files go as soon as the table is there.
WHILE_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    """WHILE_WRITING holds inside; the caller's settings come back afterwards."""
    before = {k: spark.conf.get(k) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where there is one machine, one of
    our own if it is unset; on a cluster that would lose rows, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/spindrift/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    with while_writing(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables (results of materialize) from which no frame is read any more."""
    for table in tables:
        _delete(table.sparkSession, table.scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that was written to the shared folder here. Only when no frame made from it is needed any more."""
    _delete(spark, f"{scratch_root(spark)}/spindrift")
