"""String functions of the monitoring readers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(x: Column) -> Column:
    """trimmed; empty becomes null."""
    return F.nullif(F.trim(x), F.lit(""))


def first_integer(x: Column) -> Column:
    """the first run of digits as an integer; null without one or beyond the type."""
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("int")


def capture(x: Column, pattern: str, group: int = 1) -> Column:
    """a regex group, null without a match."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def replace_chain(x: Column, steps: list[tuple[str, str]]) -> Column:
    """pattern replacements in order."""
    for pattern, replacement in steps:
        x = F.regexp_replace(x, pattern, replacement)
    return x


def prefix(x: Column, mark: str = "-") -> Column:
    """what stands before the first mark."""
    return F.substring_index(x, mark, 1)


def tail(x: Column, mark: str = "/") -> Column:
    """what stands after the last mark."""
    return F.element_at(F.split(x, mark), -1)


def seed_id(network: Column, station: Column, location: Column, channel: Column) -> Column:
    """four codes joined by dots; a null location is empty, any other null makes null."""
    return F.concat(network, F.lit("."), station, F.lit("."), F.coalesce(location, F.lit("")), F.lit("."), channel)


def lookup(x: Column, names: dict[str, str]) -> Column:
    """the canonical name of a trimmed, lower-case key; unknown keys raise."""
    pairs = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    key = F.lower(F.trim(x))
    return F.coalesce(F.try_element_at(pairs, key), F.when(x.isNotNull(), F.raise_error(F.concat(F.lit("unknown field "), key)).cast("string")))


def key_values(x: Column, pair: str = ";", mark: str = ":") -> Column:
    """A map of trimmed keys and values; the first of a repeated key wins."""
    parts = F.filter(F.split(x, pair), lambda p: F.contains(p, F.lit(mark)))
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, mark, 1)).alias("k"), F.trim(F.substr(p, F.instr(p, mark) + 1)).alias("v")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda o: o["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)
