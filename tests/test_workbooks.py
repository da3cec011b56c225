import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.operators import relational as R
from lodestream.sources import excel, tdms


def put(path, sheets, **options):
    path.write_bytes(excel.workbook(sheets, **options))


@pytest.mark.parametrize("shared", [True, False])
def test_cells_of_every_kind(spark, tmp_path, shared):
    rows = [["a<b&c", 1, None, 2.5], [], [True, " x "], [None, None, False]]
    put(tmp_path / "one.xlsx", {"S 1": rows, "S&2": [[7]]}, shared=shared)
    (tmp_path / "~lock.xlsx").write_bytes(b"no workbook")
    (tmp_path / "notes.txt").write_text("no workbook")
    got = {(r.sheet, r.row): r.cells for r in excel.cells(spark, str(tmp_path)).collect()}
    assert got == {("S 1", 1): ["a<b&c", "1", None, "2.5"], ("S 1", 3): ["TRUE", " x "], ("S 1", 4): [None, None, "FALSE"], ("S&2", 1): ["7"]}


def test_rich_text_errors_and_wide_references(spark, tmp_path):
    put(tmp_path / "a.xlsx", {"A": [["x"]]})
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/sharedStrings.xml"] = b'<sst xmlns="urn:x"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>'
    parts["xl/worksheets/sheet1.xml"] = (
        b'<x:worksheet xmlns:x="urn:x"><x:sheetData><x:row r="3"><x:c r="A3" t="s"><x:v>0</x:v></x:c><x:c r="AB3" t="e"><x:v>#N/A</x:v></x:c>'
        b'<x:c r="AC3" t="str"><x:f>1</x:f><x:v>f</x:v></x:c></x:row><x:row><x:c><x:v>5</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in parts.items():
            z.writestr(n, b)
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    got = {r.row: r.cells for r in excel.cells(spark, str(tmp_path)).collect()}
    assert got == {3: ["rich"] + [None] * 27 + ["f"], 4: ["5"]}


def test_ranges_of_rows(spark, tmp_path):
    put(tmp_path / "big.xlsx", {"A": [[i, f"t{i}"] for i in range(1, 1001)], "B": [["b"]]})
    whole = excel.cells(spark, str(tmp_path), rows_a_task=150)
    assert whole.rdd.getNumPartitions() == 8  # seven ranges of A, one of B
    assert sorted((r.sheet, r.row, r.cells[0]) for r in whole.collect()) == sorted([("A", i, str(i)) for i in range(1, 1001)] + [("B", 1, "b")])
    some = excel.cells(spark, str(tmp_path), sheets=["A"], first_row=401, last_row=500, rows_a_task=60)
    assert some.rdd.getNumPartitions() == 2
    assert sorted(r.row for r in some.collect()) == list(range(401, 501))
    both = whole.where("row = 2").union(whole.where("row > 999"))
    assert sorted(r.row for r in both.collect()) == [2, 1000] and whole.count() == 1001
    assert excel.cells(spark, str(tmp_path), sheets=["none"]).collect() == []


def test_header_and_blocks(spark, tmp_path):
    put(tmp_path / "h.xlsx", {"A": [["x"], [" measured DEPTH", "N"], ["ft", "m"], [1, 2], [3, None]], "B": [[1], [2]]})
    got = excel.below_header(excel.cells(spark, str(tmp_path)), "Measured Depth").orderBy("row").collect()
    assert [(r.sheet, r.row, r.cells, r.header) for r in got] == [("A", 4, ["1", "2"], [" measured DEPTH", "N"]), ("A", 5, ["3"], [" measured DEPTH", "N"])]
    block = [[None] * 6, ["W1", None, None, "  "], [], [1, 10, None, 2, 20], ["sum", 5], [2, "bad"]]
    put(tmp_path / "h.xlsx", {"A": block})
    got = excel.blocks(excel.cells(spark, str(tmp_path)), [0, 3], ["stage", "begin"], title_row=2, first_row=4)
    assert sorted((r.row, r.block, r.title, r.stage, r.begin) for r in got.collect()) == [(4, 0, "W1", "1", "10"), (6, 0, "W1", "2", "bad")]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("rows, width", [(20_000, 256), (300_000, 8), (0, 1)])
def test_number_rows_numbers_every_row_once(spark, adaptive, rows, width):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(0, rows, 1, 7).select(F.xxhash64("id").alias("k"), F.lit("x" * width).alias("position"), F.col("id").alias("m"))
        got = R.number_rows(df, [F.col("k")])
        assert got.columns == ["k", "m", "position"]
        n, least, most, each = got.agg(F.count("*"), F.min("position"), F.max("position"), F.count_distinct("position")).first()
        assert (n, each) == (rows, rows) and (rows == 0 or (least, most) == (1, rows))
        wrong = got.join(df.select(F.col("k").alias("k2"), "m"), "m").where("k <> k2").count()
        order = [r.k for r in got.where("position <= 1000").orderBy("position").collect()]
        assert wrong == 0 and order == sorted(order) == [r.k for r in df.orderBy("k").limit(1000).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_segments_of_every_kind(spark, tmp_path):
    times = [1_700_000_000_123_456, -5_000_001]
    plain = {"it's": (tdms.TIME, times), "b": (3, [1, -2]), "c": (tdms.TEXT, ["é", ""]), "d": (0x21, [1, 0])}
    rows = {"x": (9, [0.5, 1.5, 2.5]), "y": (8, [1, 2, 3])}
    data = tdms.segment(plain, group="G", properties={"unit": "kPa"}) + tdms.segment(plain, group="G", same=True)
    data += tdms.segment(rows, interleaved=True, big=True) + tdms.segment(rows, interleaved=True, big=True, same=True)
    twice = tdms.segment({"z": (4, [7, 8])})  # its raw data hold the chunk twice, and the begin of a third
    twice = twice[:12] + struct.pack("<Q", (1 << 64) - 1) + twice[20:] + struct.pack("<qqi", 9, 10, 1)
    (tmp_path / "one.tdms").write_bytes(data + twice)
    (tmp_path / "one.tdms_index").write_bytes(b"other")
    for size in (1, 1 << 20):
        df = tdms.values(spark, str(tmp_path), bytes_a_task=size)
        assert df.rdd.getNumPartitions() == (5 if size == 1 else 1)
        got = sorted((r.group, r.channel, r["index"], r.value, r.text, r.time_us) for r in df.collect())
        want = [("G", "it's", i, None, None, t) for i, t in enumerate(times * 2)] + [("G", "b", i, v, None, None) for i, v in enumerate([1, -2] * 2)]
        want += [("G", "c", i, None, v, None) for i, v in enumerate(["é", ""] * 2)] + [("G", "d", i, v, None, None) for i, v in enumerate([1, 0] * 2)]
        want += [("Channels", c, i, v, None, None) for c, vs in (("x", [0.5, 1.5, 2.5] * 2), ("y", [1, 2, 3] * 2), ("z", [7, 8, 9, 10])) for i, v in enumerate(vs)]
        assert got == sorted(want)
    assert {r.channel for r in tdms.values(spark, str(tmp_path), ["x"]).collect()} == {"x"}


def test_files_that_are_none(spark, tmp_path):
    (tmp_path / "a.tdms").write_bytes(b"x" * 40)
    with pytest.raises(Exception, match="no segment begins at byte 0"):
        tdms.values(spark, str(tmp_path)).collect()


def test_many_small_books_are_few_tasks_and_read_once(spark, tmp_path, monkeypatch):
    import json

    for k in range(20):
        put(tmp_path / f"{k:02}.xlsx", {"Cover": [["no"]], "A": [["Depth", k]] + [[i, k] for i in range(30)]})
    monkeypatch.setattr(excel, "TASKS", 8)
    reader = excel.ExcelSource({"paths": json.dumps(sorted(map(str, tmp_path.glob("*.xlsx")))), "rows_a_task": "10"}).reader(None)
    parts = reader.partitions()  # of 80 ranges
    assert 8 <= len(parts) <= 12 and sum(r[1] == "A" for p in parts for r in p.ranges) < 40
    rows = [(r["file"][-7:], r["sheet"], r["row"], r["cells"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == sorted([(f"{k:02}.xlsx", "Cover", 1, ["no"]) for k in range(20)] + [(f"{k:02}.xlsx", "A", i + 1, [c, str(k)]) for k in range(20) for i, c in enumerate(["Depth", *map(str, range(30))])])
    found = excel.below_header(excel.cells(spark, str(tmp_path), rows_a_task=10), "depth", skip=1)
    assert found.inputFiles() and not any(f.endswith(".xlsx") for f in found.inputFiles())
    assert found.count() == 600
