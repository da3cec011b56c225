"""Projections, filters and joins: pure functions from DataFrame to DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.storage import cut

#: Rows of both sides of a join that are dealt to a task, from DEALT_FROM tasks on.
ROWS_A_TASK = 500_000
DEALT_FROM = 16


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` in order, null where `df` lacks them."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def safe_ratio(x: Column, n: Column) -> Column:
    """|x| / n, null where n is 0."""
    return F.try_divide(F.abs(x), n)


def at_least(df: DataFrame, least: dict[str, float], most: dict[str, float], missing_low: float = 0.0, missing_high: float = 9999.0) -> DataFrame:
    """Rows that reach every lower limit and keep every upper one; nulls count as a value on the failing side."""
    tests = [F.coalesce(F.col(c), F.lit(missing_low)) >= v for c, v in least.items()]
    tests += [F.coalesce(F.col(c), F.lit(missing_high)) <= v for c, v in most.items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def exclude(df: DataFrame, rejected: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in `rejected`; rows with a null key stay."""
    return df.join(rejected.select(on).distinct(), on, "left_anti")


def keep(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in `wanted`."""
    return df.join(wanted.select(on).distinct(), on, "left_semi")


def bounding_box(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside closed ranges."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in limits.items()], F.lit(True)))


def day_range(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """From the start of `first` to the end of `last`, both inclusive."""
    start, stop = F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return df.where((F.col(ts) >= start) & (F.col(ts) <= stop))


def clamp_negative(x: Column) -> Column:
    """0 for negatives; null stays null."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def sigma_clip(df: DataFrame, value: str, k: float) -> DataFrame:
    """Rows within k population standard deviations of the mean over all rows (one row is broadcast)."""
    limits = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.join(F.broadcast(limits)).where(F.abs(F.col(value) - F.col("_mean")) <= k * F.col("_sd")).drop("_mean", "_sd")


def filter_nested(df: DataFrame, array: str, field: str, least: float, min_left: int) -> DataFrame:
    """Array members of at least `least` in `field` (null members stay); rows keep `min_left` members or go."""
    kept = F.filter(F.col(array), lambda p: p[field].isNull() | (p[field] >= least))
    return df.withColumn(array, kept).where(F.size(array) >= min_left)


def missing_reason(columns: dict[str, Column]) -> Column:
    """Names of the failed conditions, comma-separated."""
    return F.concat_ws(", ", *[F.when(test, F.lit(name)) for name, test in columns.items()])


def merge_full(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of all frames on null-safe keys; for a column of several frames the first non-null wins."""

    def two(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
        out = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
        for c in dict.fromkeys([c for c in left.columns + right.columns if c not in keys]):
            both = [F.col(f"{t}.{c}") for t, d in (("a", left), ("b", right)) if c in d.columns]
            out.append(F.coalesce(*both).alias(c))
        return a.join(b, on, "full").select(out)

    return reduce(two, frames)


def first_non_null(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first non-null value of every other column per key, in the order of `order`; null keys group."""
    place = F.struct(*order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest])


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def update_by_key(current: DataFrame, changes: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows of `changes` replace those of the same key, keys in `removed` go unless replaced."""
    rest = current.join(changes.select(key), key, "left_anti").join(removed.select(key), key, "left_anti")
    return rest.unionByName(changes.join(current.select(key), key, "left_semi"))


def dealt(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join dealt by its key to tasks of ROWS_A_TASK rows, so that these don't grow with the tables,
    whatever the session's number of partitions; small tables stay as they are. No key should have many rows."""
    tasks = (left.count() + right.count()) // ROWS_A_TASK + 1
    if tasks < DEALT_FROM:
        return left, right
    return left.repartition(tasks, left_key), right.repartition(tasks, right_key)


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], name: str = "position") -> DataFrame:
    """The n-th row of one side with the n-th of the other. Places are counted by ordered partitions."""
    a, b = number_rows(left, left_order, name), number_rows(right, right_order, name)
    return a.join(b, name)


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Consecutive numbers from 1 in a global order; ties are numbered in any order, a column `name` is replaced.

    The sorted rows are written once with their place in their partition, so that what is counted is what is numbered:
    a second sort would draw other bounds. What lies before a partition is summed over partitions, not rows.
    """
    columns = [c for c in df.columns if c != name]
    ordered = df.orderBy(*order).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), F.monotonically_increasing_id().alias("m"))
    rows = cut(ordered).withColumn("p", F.shiftright("m", 33))
    sizes = rows.groupBy("p").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = cut(sizes.select("p", (before - F.col("first") + 1).alias("shift")))  # a row a partition
    return rows.join(F.broadcast(offsets), "p").select("r.*", (F.col("m") + F.col("shift")).alias(name))


def compare_membership(left: DataFrame, right: DataFrame, key: str, names=("both", "left_only", "right_only")) -> DataFrame:
    """Every key of either side and where it was found."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    where = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), names[0]).when(F.col("_l").isNotNull(), names[1]).otherwise(names[2])
    return a.join(b, key, "full").select(key, where.alias("membership"))


def rounded_dedup(df: DataFrame, exact: list[str], rounded: dict[str, int], always: Column, *order: Column) -> DataFrame:
    """The first row per exact and rounded key; rows for which `always` holds all stay."""
    keys = [F.col(c) for c in exact] + [F.bround(c, n) for c, n in rounded.items()]
    rank = F.row_number().over(Window.partitionBy(*keys, always).orderBy(*order))
    return df.withColumn("_rank", rank).where((F.col("_rank") == 1) | always).drop("_rank")
