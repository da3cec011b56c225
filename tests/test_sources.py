import json

import pytest

from lodestream.sources import readers as R
from lodestream.sources import writers as W
from pyspark.sql import functions as F

ALIASES = {"x": ("EASTINGM", "X (m)"), "mag": ("MomMag", "MOMMAG"), "time": ("ORIGINDATETIME",)}
KINDS = {"x": "double", "mag": "double", "time": "timestamp_ntz", "well": "string"}


def test_csv_aliases_flavours_and_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" EASTINGM , MOMMAG,ORIGINDATETIME\n1.5, -0.3 ,2024-01-02 03:04:05\nbad,1,2024-01-02 00:00:00\n")
    (tmp_path / "b.csv").write_text("X (m),MomMag,well\n7,0.5,W1\n")
    (tmp_path / "c.csv").write_text("nothing,known\n1,2\n")
    read = lambda p: R.csv(spark, p, ALIASES, KINDS, ("x",))
    assert [tuple(r) for r in read(str(tmp_path / "a.csv")).select("x", "mag", "well").collect()] == [(1.5, -0.3, None)]
    flavours = {"one": ({"eastingm"}, read), "two": ({"x (m)", "well"}, read)}
    by = lambda p: R.csv_by_flavour(spark, p, flavours)
    with pytest.raises(ValueError):
        by(str(tmp_path / "c.csv"))
    got = R.csv_folder(spark, [str(tmp_path / f"{n}.csv") for n in "abc"], by).collect()
    assert sorted((r.x, r.source_file) for r in got) == [(1.5, "a.csv"), (7.0, "b.csv")]


def test_units_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "i.csv").write_text("﻿Time, PT 503, Net Flow,\n(s), (psi), (gpm),\n-,-,-,\n01/02/24 03:04:05, 10.5, x,\n\n02/02/24 03:04:05, 11, 2,\n", encoding="utf-8")
    got = R.csv_with_units(spark, str(tmp_path / "i.csv"), {"Time": "string", "PT 503": "double", "Net Flow": "double"}).collect()
    assert [tuple(r) for r in got] == [("01/02/24 03:04:05", 10.5, None), ("02/02/24 03:04:05", 11.0, 2.0)]


def test_key_values_xml_json_and_tables(spark, tmp_path):
    (tmp_path / "d.txt").write_text("template: t1; detect_time: 2024-01-01T00:00:00; no_chans: 5; threshold: 8.0\nnoise\ntemplate: t2; no_chans: many\n")
    kinds = {"template": "string", "detect_time": "timestamp_ntz", "no_chans": "int"}
    got = R.key_value_lines(spark, str(tmp_path / "d.txt"), kinds).collect()
    assert [(r.template, r.no_chans) for r in got] == [("t1", 5), ("t2", None)] and str(got[0].detect_time) == "2024-01-01 00:00:00"
    frame = "<logs><log><endDateTimeIndex>2024-01-01T00:00:00.000</endDateTimeIndex><logData><data>1, 20.5</data><data>2, bad</data></logData><customData><referenceTemperature>3.5</referenceTemperature><probe1Temperature>1</probe1Temperature></customData></log></logs>"
    (tmp_path / "f.xml").write_text(frame)
    got = R.xml_frames(spark, str(tmp_path / "f.xml"), 2).collect()
    assert [(r.row, r.v0, r.v1, r.reference, r.probe2) for r in got] == [(0, 1.0, 20.5, 3.5, None), (1, 2.0, None, 3.5, None)]
    info = {"meas_start_time": "2024-01-01T00:00:00Z", "meas_end_time": "2024-01-01T00:00:10Z"}
    (tmp_path / "j.json").write_text(json.dumps({"info": info, "points": [{"distance": 1.0, "peak1": {"value": 2.0, "width": 3.0, "gain": 4.0}}, {"distance": 2.0}]}, indent=1))
    got = R.json_frames(spark, str(tmp_path / "j.json")).collect()
    assert [(str(r.ts), r.distance, r.value) for r in got] == [("2024-01-01 00:00:05", 1.0, 2.0), ("2024-01-01 00:00:05", 2.0, None)]
    (tmp_path / "h.reloc").write_text(" ".join(["1"] * 15 + ["0", "-9"]) + "\n" + "1 2 3\n" + " ".join(["2"] * 14 + ["***", "1.2", "0.5", "9"]) + "\n")
    names = [f"c{i}" for i in range(15)] + ["mag", "rcc", "extra"]
    got = R.relocation_table(spark, str(tmp_path / "h.reloc"), names).collect()
    assert [(r.c14, r.mag, r.rcc, r.extra) for r in got] == [(1.0, 0.2, None, None), (None, 1.2, 0.5, 9.0)]
    (tmp_path / "m.asc").write_text("Header line\n1 2 3\n 4\t5 6 \n")
    assert [r["values"] for r in R.ascii_matrix(spark, str(tmp_path / "m.asc"), 1).collect()] == [[3.0, 2.0, 1.0], [6.0, 5.0, 4.0]]
    assert R.files_between(["a/x_20240101.json", "a/x_20240102.json", "a/x_20240103.json"], r"_(\d{8})", "20240101", "20240103") == ["a/x_20240102.json"]


def test_groups_and_ledger(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], ["id", "Group 1 Tp", "Group 1 Ts", "Group 2 Tp"])
    got = R.group_columns(df, r"Group (\d+) (\w+)", ["id"]).collect()
    assert [(r["group"], r.Tp, r.Ts) for r in got] == [(1, 1.0, 2.0), (2, 3.0, None)]
    listing = spark.createDataFrame([("a",), ("b",)], ["path"])
    assert [r.path for r in R.unseen(listing, spark.createDataFrame([("a",)], ["path"])).collect()] == ["b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "P", 2.5), (2, "S", None)], "k int, phase string, v double")
    W.lines(df, str(tmp_path / "obs"), W.fixed_width(df, [("phase", "%-4s"), ("v", "%8.3f")]), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "obs")).collect()] == ["P       2.500", "S            "]
    W.by_key(df, str(tmp_path / "t"), ["phase"])
    assert spark.read.parquet(str(tmp_path / "t")).where("phase = 'S'").count() == 1
    W.csv(df, str(tmp_path / "c"), ["k"])
    assert R.csv(spark, str(tmp_path / "c"), {}, {"v": "double"}).agg(F.sum("v")).first()[0] == 2.5
    W.publish(df, str(tmp_path / "p"), "2024-01")
    W.publish(df.limit(1), str(tmp_path / "p"), "2024-02")
    assert W.latest(spark, str(tmp_path / "p")).count() == 1
