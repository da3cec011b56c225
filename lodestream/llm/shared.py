"""Tables in the shared folder: they cut lineage, so that a lost executor repeats one step and not the whole job."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids and hashes up to which a table is sent to every task: some 7 MB.
BROADCAST_ROWS = 100_000
_BATCH, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304"
#: Names that columns of the input are taken not to have.
_ID, VERSION = "__lodestream_id", "__lodestream_version"


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset one is made and set, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/lodestream/{name}-{uuid.uuid4().hex}"


def wide_rows(spark: SparkSession) -> None:
    """Let a batch that goes to Python hold few bytes: rows hold whole texts, and workers share an executor's memory."""
    spark.conf.set(_BATCH, _BYTES)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold inside only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """At the end of a Python task: return memory that nothing holds, as the worker lives on beside others."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` to be sent to every task if it has BROADCAST_ROWS rows at most (counted here, or `rows`), else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def without(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str = "left_anti") -> DataFrame:
    """The rows of `docs` that `rows` (id_col and version, a hash of the text; ids may be null) doesn't name.

    Columns stay as they are, whatever they are called; with how="left_semi" the rows that are named. Texts
    are shuffled only if `rows` is too large to be sent to every task.
    """
    named = small(rows.select(F.col(id_col).alias(_ID), F.col("version").alias(VERSION)))
    same = F.col(id_col).eqNullSafe(F.col(_ID)) & (F.xxhash64(text_col) == F.col(VERSION))
    return docs.join(named, same, how)


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that `store` returned and nothing reads any more."""
    for df in tables:
        _drop(df)


def _drop(df: DataFrame) -> None:
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
