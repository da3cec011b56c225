"""Time parsing and conversion, as column expressions; timestamps carry no zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_first(x: Column, formats: list[str]) -> Column:
    """F20 per row: the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_voted(df: DataFrame, column: str, formats: list[str], name: str = "ts") -> DataFrame:
    """F20 as a column decision: the first format that fits any row parses all of them."""
    hits = df.agg(*[F.count(F.try_to_timestamp(column, F.lit(f))).alias(f"f{i}") for i, f in enumerate(formats)]).first()
    chosen = next((f for i, f in enumerate(formats) if hits[i]), formats[0])
    return df.withColumn(name, F.try_to_timestamp(column, F.lit(chosen)).cast("timestamp_ntz"))


def from_datenum(days: Column) -> Column:
    """days since year 0 (719529 is 1970-01-01)."""
    return F.timestamp_micros(F.round((days - 719529) * 86_400_000_000).cast("long")).cast("timestamp_ntz")


def to_datenum(ts: Column) -> Column:
    """F21"""
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000 + 719529


def from_serial(days: Column) -> Column:
    """spreadsheet day numbers since 1899-12-30."""
    return from_datenum(days + (719529 - 25569))


def parse_injection_times(df: DataFrame, column: str, day: str, share: float = 0.8, name: str = "ts") -> DataFrame:
    """by a vote of `share` of the rows: month/day/year texts, fractions of `day`, or spreadsheet days."""
    text = F.try_to_timestamp(column, F.lit("M/d/yy H:m:s"))
    number = F.col(column).try_cast("double")
    votes = df.agg(F.avg(text.isNotNull().cast("int")), F.avg(((number >= 0) & (number < 1)).cast("int")), F.avg((number > 20_000).cast("int"))).first()
    if (votes[0] or 0) >= share:
        parsed = text.cast("timestamp_ntz")
    elif (votes[1] or 0) >= share:
        parsed = from_datenum(to_datenum(F.lit(day).cast("timestamp_ntz")) + number)
    elif (votes[2] or 0) >= share:
        parsed = from_serial(number)
    else:
        parsed = F.col(column).try_cast("timestamp_ntz")
    return df.withColumn(name, parsed)


def local_to_utc(ts: Column, zone: str) -> Column:
    """Wall time of a zone to UTC. Etc/GMT+2 is two hours west (trap T-09)."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def roll_overnight(start: Column, end: Column) -> Column:
    """an end before its start lies on the next day."""
    return F.when(end < start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)


def fractional_year(x: Column) -> Column:
    """a year with a fraction of always 365 days."""
    start = F.make_timestamp_ntz(F.floor(x).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    seconds = F.round((x - F.floor(x)) * 365 * 86400).cast("long")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def epoch_label(x: Column) -> Column:
    """12 or 14 digits, else 1970-01-01."""
    digits = F.regexp_extract(x, r"(\d{14}|\d{12})", 1)
    parsed = F.when(F.length(digits) == 14, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))).when(F.length(digits) == 12, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm")))
    return F.coalesce(parsed.cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))


def days(first: Column, last: Column) -> Column:
    """one row a day, both ends included."""
    return F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY")))
