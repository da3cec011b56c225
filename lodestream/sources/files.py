"""Files that no reader of Spark's knows: listed by the driver, opened in tasks, and written by them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, path: str, ending: str) -> list[str]:
    """Files with this ending at `path`, a file or a folder, by name. As with any file source, names go to the driver."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.isFile(place):
        return [files.makeQualified(place).toString()]
    found, walk = [], files.listFiles(place, True)
    while walk.hasNext():
        name = walk.next().getPath().toString()
        base = name.rpartition("/")[2]
        if base.lower().endswith(ending) and not base.startswith((".", "_", "~")):
            found.append(name)
    return sorted(found)


def opened(path: str):
    """A file as a binary stream that can seek, in any store that Arrow or this machine knows."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb")  # noqa: SIM115  the caller closes it
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def write_each(df: DataFrame, keys: list[str], folder: str, ending: str, content: Callable[[pd.DataFrame], bytes]) -> None:
    """A file for each group of `keys`, made by `content` in the group's task; groups hold what one file should.

    `folder` is one that all machines share. A file has its name only when it is whole, and a group that is
    written again, after a loss, writes the same name.
    """
    local = urlparse(folder).path if urlparse(folder).scheme in ("", "file") else folder

    def put(frame: pd.DataFrame) -> pd.DataFrame:
        name = "-".join(str(frame[k].iloc[0]) for k in keys)
        os.makedirs(local, exist_ok=True)
        part = os.path.join(local, f".{name}-{uuid.uuid4().hex}")
        with open(part, "wb") as f:
            f.write(content(frame))
        os.replace(part, os.path.join(local, name + ending))
        return pd.DataFrame({"name": [name]})

    df.groupBy(*keys).applyInPandas(put, "name string").agg(F.count("*")).collect()
