import struct

import numpy as np

from lodestream.sources import binary as B
from lodestream.sources import writers as W


def test_epoch_cubes(spark, tmp_path):
    data = np.zeros((2, 3, 4), np.float32)
    data[0, 1], data[1, 2], data[1, 0] = [1, 2, 3, 4], 5, 6
    np.savez_compressed(tmp_path / "202401010000.npz", data=data)
    got = sorted(tuple(r)[:3] for r in B.epoch_cubes(spark, str(tmp_path), (0,)).collect())
    assert got == [("202401010000", 0, 1), ("202401010000", 1, 2)]


def test_scatter_points(spark, tmp_path):
    (tmp_path / "ev1.scat").write_bytes(struct.pack("<i3f", 2, 0, 0, 0) + struct.pack("<8f", *range(8)))
    assert [tuple(r) for r in B.scatter_points(spark, str(tmp_path)).collect()] == [("ev1", 0, 1, 2, 3), ("ev1", 4, 5, 6, 7)]


def test_catalog_events(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<q><event publicID="smi:x/1"><preferredOriginID>o2</preferredOriginID>'
        '<origin publicID="o1"><time><value>2024-01-01T00:00:00</value></time><depth><value>1</value></depth></origin>'
        '<origin publicID="o2"><time><value>2024-01-02T00:00:00</value></time><longitude><value>7.5</value></longitude><depth><value>2</value></depth></origin>'
        '<magnitude><mag><value>-0.5</value></mag></magnitude>'
        '<pick><time><value>2024-01-02T00:00:01</value></time><waveformID stationCode="S1" channelCode="GPZ"/><phaseHint>P</phaseHint></pick></event>'
        '<event publicID="smi:x/2"><origin publicID="o3"><depth><value>9</value></depth></origin></event></q>'
    )
    got = sorted(B.catalog_events(spark, str(tmp_path / "a.xml")).collect(), key=lambda r: r.event_id)
    assert [(r.event_id, r.depth, r.magnitude, len(r.picks)) for r in got] == [("1", 2.0, -0.5, 1), ("2", 9.0, None, 0)]
    assert got[0].picks[0].station == "S1" and got[0].longitude == 7.5


def test_location_outputs(spark, tmp_path):
    (tmp_path / "a.hyp").write_text(
        "NLLOC \nGEOGRAPHIC  OT 2024 01 02  03 04 5.5  Lat 44.1 Long -103.7 Depth 1.25\n"
        "QUALITY  Pmax 1 MFmin 2 MFmax 3 RMS 0.012 Nphs 8 Gap 120.5 Dist 1\n"
        "PHASE ID Ins Cmp On Pha  FM Date     HrMn   Sec     Err  ErrMag    Coda      Amp       Per  >   TTpred    Res\n"
        "ST01   ?    ?    ? P      ? 20240102 0304    5.6 GAU  1  2  3  4  >  0.105  -0.002\n"
    )
    r = B.location_outputs(spark, str(tmp_path)).first()
    assert (str(r.ts), r.depth, r.rms, r.n_phases) == ("2024-01-02 03:04:05.500000", 1.25, 0.012, 8)
    assert [tuple(p) for p in r.phases] == [("ST01", "P", 0.105, -0.002)]


def test_location_outputs_of_many_events(spark, tmp_path):
    event = "NLLOC \nGEOGRAPHIC  OT 2024 01 02  03 04 {0}.5  Lat 44.1 Long -103.7 Depth {0}.25\nST0{0}   ?    ?    ? P      ? 20240102 0304    5.6 GAU  1  2  3  4  >  0.105  -0.002\n"
    (tmp_path / "a.hyp").write_text("".join(event.format(i) + "END_NLLOC\n" for i in range(3)) + event.format(3) + event.format(4))
    (tmp_path / "b.hyp").write_text(event.format(5))
    rows = sorted(B.location_outputs(spark, str(tmp_path)).collect(), key=lambda r: r.ts)
    assert [(r.file, r.depth, [p.station for p in r.phases]) for r in rows] == [("b.hyp" if i == 5 else "a.hyp", i + 0.25, [f"ST0{i}"]) for i in range(6)]


def test_location_scan_writes_few_files(spark, tmp_path):
    from lodestream.plans import formats

    spark.range(500).selectExpr("id as s_suppkey", "format_string('Supplier#%09d', id) as s_name", "double(id) / 4 as s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    found = formats.location_scan(spark, str(tmp_path))
    assert found.count() == 500 and len(found.inputFiles()) <= 8


def test_day_partitions(spark, tmp_path):
    df = spark.createDataFrame([("2024001", "A", 1), ("2024002", "A", 2), ("2024001", "B", 3)], "day string, station string, v int")
    W.by_key(df, str(tmp_path / "w"), ["day", "station"])
    got = B.day_partitions(spark, str(tmp_path / "w"), ["2024001"], ["B"])
    assert [r.v for r in got.collect()] == [3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
