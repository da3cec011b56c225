"""Workbooks and segmented binary files: tables are written in these formats, a file for a bounded range of keys, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestream.session import table
from lodestream.sources import excel, files, tdms
from lodestream.storage import checkpoint_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query under its own name with its DuckDB counterpart."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _path(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stage_book(frame):
    """Three blocks of four columns side by side, from column 15 on: a title in row 2, stages from row 4 on."""
    rows = [[None] * 27 for _ in range(3 + len(frame))]
    for b, start in enumerate((15, 19, 23)):
        part = frame[frame["block"] == b].sort_values("stage")
        if len(part):
            rows[1][start] = f" Well {b} "
            for i, r in enumerate(part.itertuples(), 3):
                rows[i][start : start + 4] = ["Total" if r.stage % 7 == 0 else r.stage, r.begin, r.end, "n/a" if r.stage % 5 == 0 else r.end - r.begin]
    return excel.workbook({"Notes": [["made for tests"]], "Perf <1>": rows})


@query("""
SELECT p_partkey AS stage, 'Well ' || p_partkey % 3 AS well, p_retailprice AS begin_m, p_retailprice + p_size AS end_m,
  CASE WHEN p_partkey % 5 <> 0 THEN round((p_retailprice + p_size) - p_retailprice, 6) END AS length_m, p_retailprice + p_size / 2.0 AS mid_m
FROM part WHERE p_partkey % 7 <> 0""")
def excel_blocks(spark, sf):
    """Blocks side by side in a workbook's sheet, stacked; totals and texts among the numbers"""
    p = table(spark, sf, "part")
    path = _path(spark, "stages")
    rows = p.select(F.expr("p_partkey div 900").alias("file"), (F.col("p_partkey") % 3).alias("block"), F.col("p_partkey").alias("stage"), F.col("p_retailprice").alias("begin"), (F.col("p_retailprice") + F.col("p_size")).alias("end"))
    files.write_each(rows, ["file"], path, ".xlsx", _stage_book)
    found = excel.cells(spark, path, sheets=["Perf <1>"])
    stacked = excel.blocks(found, [15, 19, 23], ["stage", "begin", "end", "length"], title_row=2, first_row=4)
    begin, end = excel.number(F.col("begin")), excel.number(F.col("end"))
    return stacked.select(
        F.col("stage").cast("long").alias("stage"), F.col("title").alias("well"), begin.alias("begin_m"), end.alias("end_m"),
        F.round(excel.number(F.col("length")), 6).alias("length_m"), ((begin + end) / 2).alias("mid_m"),
    )


def _plan_book(frame):
    """A few lines of title, a header row, a row of units, and stations; some of them without a number."""
    head = [["Plan", None, "of"], [], ["Well", "x"], ["Rev. 2"]][: int(frame["file"].iloc[0]) % 5]
    names = [["  Measured Depth", "Inc", "Azi", "TVD", "N", "SubSea TVD"], ["(ft)", "(deg)", "(deg)", "(ft)", "(ft)", "(ft)"]]
    body = [[r.key, None, True, r.price, "x & y", "--" if r.key % 11 == 0 else r.price * 0.3048] for r in frame.sort_values("key").itertuples()]
    return excel.workbook({"Cover": [["nothing"]], "Plan": head + names + body}, shared=False)


@query("""
SELECT o_orderkey AS depth, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice * 0.3048, 6) END AS sstvd, 'SubSea TVD' AS header,
  o_orderkey % 11 <> 0 AS valid
FROM orders""")
def excel_header_row(spark, sf):
    """The header row is found by its first cell; the data begin two rows below, other sheets have none"""
    o = table(spark, sf, "orders")
    path = _path(spark, "plans")
    rows = o.select(F.expr("o_orderkey div 2500").alias("file"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    files.write_each(rows, ["file"], path, ".xlsx", _plan_book)
    found = excel.below_header(excel.cells(spark, path, rows_a_task=1000), "measured depth", skip=2)
    sstvd = F.round(excel.number(F.get("cells", F.lit(5))), 6)
    return found.select(excel.number(F.get("cells", F.lit(0))).cast("long").alias("depth"), sstvd.alias("sstvd"), F.get("header", F.lit(5)).alias("header"), sstvd.isNotNull().alias("valid"))


def _pump_file(frame):
    """Segments of 1000 rows, in turns plain, interleaved and with the other byte order."""
    out = b""
    for k in range(0, len(frame), 1000):
        part = frame.iloc[k : k + 1000]
        channels = {
            "Time": (tdms.TIME, part["t"].tolist()), "Interval pressure": (10, part["pressure"].tolist()), "Pump flow": (9 if k % 2000 else 10, part["flow"].tolist()), "State": (3, part["flow"].tolist()),
        }
        out += tdms.segment(channels, big=k % 3000 == 1000, interleaved=k % 3000 == 2000, properties={"unit": "kPa"})
    return out


@query("""
SELECT o_orderdate + INTERVAL 1 HOUR AS time, o_totalprice / 1000 AS "Pressure", o_custkey::DOUBLE AS "Flow" FROM orders""")
def pump_files(spark, sf):
    """Pump data of segmented binary files, from their zone to UTC and from kPa to MPa"""
    o = table(spark, sf, "orders")
    path = _path(spark, "pumps")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rows = o.select(F.expr("o_orderkey div 6000").alias("file"), (seconds * 1_000_000).alias("t"), F.col("o_totalprice").alias("pressure"), F.col("o_custkey").alias("flow"))
    files.write_each(rows, ["file"], path, ".tdms", _pump_file)
    return tdms.pump_data(spark, path)
