"""Cutting lineage in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is sent to every task.
SMALL = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset one is made, in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="lodestream-"))
    return context.getCheckpointDir()


def small(df: DataFrame) -> DataFrame:
    """`df` to be sent to every task if it has SMALL rows at most, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def joined_with(df: DataFrame, items: int = 1) -> DataFrame:
    """`df` for a join that doesn't fill the driver: broadcast if it has SMALL rows at most, or items of its arrays, else both sides are sorted.

    Spark estimates a table by its files, which tells little of its rows once they are decoded or copied.
    """
    most = SMALL // items
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, so that a lost executor repeats what follows only.

    A table carries neither lineage nor the constraints of its plan, which grow from round to round in a loop.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that `cut` returned and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
