"""Sinks: tables by key, fixed-width text, bundles with a manifest, and the published latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """Parquet folders by key; the job's commit makes them visible at once."""
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def csv(df: DataFrame, path: str, order: list[str] = ()) -> None:
    """Headed CSV, sorted within files."""
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def fixed_width(df: DataFrame, columns: list[tuple[str, str]]) -> Column:
    """One line from printf formats of columns; null prints as nothing of that width."""
    parts = []
    for name, form in columns:
        width = int("".join(ch for ch in form.split(".")[0] if ch.isdigit()) or 0)
        parts.append(F.coalesce(F.format_string(form, F.col(name)), F.lit(" " * width)) if width else F.format_string(form, F.col(name)))
        parts[-1] = F.when(F.col(name).isNull(), F.lit(" " * width)).otherwise(parts[-1])
    return F.concat_ws(" ", *parts)


def lines(df: DataFrame, path: str, line: Column, order: list[str], keys: list[str] = ()) -> None:
    """Text files, by key if any, lines in order within each."""
    out = df.select(*keys, *order, line.alias("value"))
    out = out.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else out.orderBy(*order)
    writer = out.select(*keys, "value").write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def publish(df: DataFrame, folder: str, version: str) -> None:
    """A version's table, and then a manifest row that makes it the latest."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")
    spark = df.sparkSession
    n = spark.read.parquet(f"{folder}/version={version}").count()
    spark.createDataFrame([(version, n)], "version string, n long").write.mode("append").parquet(f"{folder}/_manifest")


def latest(spark, folder: str) -> DataFrame:
    """The table of the greatest version in the manifest."""
    version = spark.read.parquet(f"{folder}/_manifest").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/version={version}")
