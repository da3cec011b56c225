"""Readers of the monitoring formats: text, CSV, XML and JSON, lazily and in parallel over files.

Bad numbers and times become null; whether such rows go is the caller's choice, by `required`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.functions.text import key_values


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a CSV file or folder as written, trimmed, without a byte-order mark."""
    line = spark.read.text(path).limit(1).first()
    return [c.strip().strip('"') for c in line[0].lstrip("﻿").split(sep)] if line else []


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]], kinds: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns by any of their spellings (case and blanks don't matter), tried as their kind; missing ones are null."""
    have = {c.strip().lower(): c for c in df.columns}
    out = []
    for name, kind in kinds.items():
        found = next((have[a.lower()] for a in (name, *aliases.get(name, ())) if a.lower() in have), None)
        value = F.lit(None).cast(kind) if found is None else F.trim(F.col(f"`{found}`")).try_cast(kind)
        out.append(value.alias(name))
    return df.select(out).dropna("any", subset=list(required)) if required else df.select(out)


def csv(spark: SparkSession, paths: str | list[str], aliases: dict, kinds: dict[str, str], required: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """Headed text files of one shape, every column read as text first."""
    raw = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(paths)
    return aliased(raw, aliases, kinds, required)


def csv_by_flavour(spark: SparkSession, path: str, flavours: dict[str, tuple[set[str], Callable[[str], DataFrame]]]) -> DataFrame:
    """The reader of the first flavour whose marks the header has; an unknown header raises."""
    names = {c.lower() for c in header(spark, path)}
    for marks, read in flavours.values():
        if {m.lower() for m in marks} <= names:
            return read(path)
    raise ValueError(f"unknown header in {path}: {sorted(names)}")


def csv_folder(spark: SparkSession, files: list[str], read: Callable[[str], DataFrame], origin: str = "source_file") -> DataFrame:
    """Files of differing headers, with the name of each; a file of unknown header is left out."""
    parts = []
    for path in files:
        try:
            parts.append(read(path).withColumn(origin, F.lit(path.rsplit("/", 1)[-1])))
        except ValueError:
            continue
    if not parts:
        raise ValueError("no readable file")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def csv_with_units(spark: SparkSession, path: str, kinds: dict[str, str], unit_rows: int = 2) -> DataFrame:
    """A byte-order mark, a header, rows of units, and trailing commas.

    The rows to leave out are those equal to the header or one of the first rows after it: units are no data
    anywhere in the file, so no row needs a number.
    """
    head = spark.read.text(path).limit(1 + unit_rows).collect()
    names = [c.strip() for c in head[0][0].lstrip("﻿").split(",")]
    skip = [r[0] for r in head]
    rows = spark.read.text(path).where(~F.col("value").isin(skip) & (F.trim("value") != ""))
    parts = F.split(F.regexp_replace("value", "^﻿", ""), ",")
    return rows.select([F.trim(F.get(parts, F.lit(names.index(c)))).try_cast(k).alias(c) if c in names else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def key_value_lines(spark: SparkSession, paths: str | list[str], kinds: dict[str, str]) -> DataFrame:
    """Lines of `key: value; key: value`."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).where(F.contains("value", F.lit(":")))
    pairs = lines.select(key_values(F.col("value")).alias("_pairs"))
    return pairs.select([F.try_element_at("_pairs", F.lit(c)).try_cast(k).alias(c) for c, k in kinds.items()])


def xml_frames(spark: SparkSession, paths: str | list[str], fields: int) -> DataFrame:
    """Log frames: end time, reference and probe temperatures, and a row for every data line."""
    schema = T.StructType.fromDDL(
        "endDateTimeIndex STRING, logData STRUCT<data: ARRAY<STRING>>, customData STRUCT<referenceTemperature: DOUBLE, probe1Temperature: DOUBLE, probe2Temperature: DOUBLE>"
    )
    frames = spark.read.format("xml").option("rowTag", "log").schema(schema).load(paths)
    lines = frames.select(
        F.col("endDateTimeIndex").try_cast("timestamp_ntz").alias("ts"), F.col("customData.referenceTemperature").alias("reference"),
        F.col("customData.probe1Temperature").alias("probe1"), F.col("customData.probe2Temperature").alias("probe2"), F.posexplode("logData.data").alias("row", "line"),
    )
    parts = F.split("line", ",")
    return lines.select("ts", "reference", "probe1", "probe2", "row", *[F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(f"v{i}") for i in range(fields)])


def json_frames(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Fiber frames: mid time, distance, and the first peak of every point."""
    schema = T.StructType.fromDDL("info STRUCT<meas_start_time: STRING, meas_end_time: STRING>, points ARRAY<STRUCT<distance: DOUBLE, peak1: STRUCT<value: DOUBLE, width: DOUBLE, gain: DOUBLE>>>")
    frames = spark.read.schema(schema).option("multiLine", True).json(paths)
    start, end = F.col("info.meas_start_time").try_cast("timestamp"), F.col("info.meas_end_time").try_cast("timestamp")
    middle = F.timestamp_micros((F.unix_micros(start) + (F.unix_micros(end) - F.unix_micros(start)) / 2).cast("long")).cast("timestamp_ntz")
    return frames.select(middle.alias("ts"), F.explode("points").alias("p")).select("ts", "p.distance", "p.peak1.value", "p.peak1.width", "p.peak1.gain")


def files_between(names: list[str], pattern: str, first: str, last: str) -> list[str]:
    """Paths whose name holds a stamp strictly between two others (stamps that sort as text)."""
    import re

    stamps = [(re.search(pattern, n.rsplit("/", 1)[-1]), n) for n in names]
    return [n for m, n in stamps if m and first < m.group(1) < last]


def ascii_matrix(spark: SparkSession, paths: str | list[str], skip: int, flip: bool = True) -> DataFrame:
    """Numbers in blank-separated lines as arrays, reversed if `flip`; `skip` header lines start with no number."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    rows = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), numbers.alias("values"))
    rows = rows.where(~F.exists("values", lambda x: x.isNull())) if skip else rows
    return rows.withColumn("values", F.reverse("values")) if flip else rows


def relocation_table(spark: SparkSession, paths: str | list[str], names: list[str]) -> DataFrame:
    """Blank-separated event rows: shorter than 17 go, shorter than the names are filled, stars and -9 of rcc are null, a magnitude of 0 counts as 0.2."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(paths).select(parts.alias("t")).where(F.size("t") >= 17)
    out = [F.get("t", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(names)]
    df = rows.select(out)
    if "rcc" in names:
        df = df.withColumn("rcc", F.nullif("rcc", F.lit(-9.0)))
    return df.withColumn("mag", F.when(F.col("mag") == 0, 0.2).otherwise(F.col("mag"))) if "mag" in names else df


def group_columns(df: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    """Columns named by group number and field (`pattern` has both) as rows: keys, group, one column a field."""
    import re

    found = [(c, re.match(pattern, c)) for c in df.columns]
    by_group: dict[int, dict[str, str]] = {}
    for c, m in found:
        if m:
            by_group.setdefault(int(m.group(1)), {})[m.group(2)] = c
    fields = sorted({f for g in by_group.values() for f in g})
    rows = F.array(*[F.struct(F.lit(g).alias("group"), *[(F.col(f"`{cols[f]}`") if f in cols else F.lit(None).cast("double")).alias(f) for f in fields]) for g, cols in sorted(by_group.items())])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def unseen(listing: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """What the ledger of ingested files or days lacks."""
    return listing.join(ledger.select(key), key, "left_anti")


def scaled(df: DataFrame, value: str, scale: Column | float) -> Column:
    """Unit conversion."""
    return df[value] * scale
