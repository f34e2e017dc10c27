import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.sources import envi
from scanforge.sources import nav as sources
from scanforge.streaming import calibration as streaming


@pytest.mark.parametrize("interleave", ["bil", "bsq"])
def test_cube_reads_with_filters(spark, tmp_path, interleave):
    cube = np.arange(4 * 3 * 5, dtype="<u2").reshape(4, 3, 5)  # line, band, sample
    (cube if interleave == "bil" else cube.transpose(1, 0, 2)).tofile(tmp_path / "a.dat")
    (tmp_path / "a.hdr").write_text(envi.format_header({"samples": 5, "lines": 4, "bands": 3, "data type": 12, "interleave": interleave, "wavelength": [1.5, 2.5, 3.5]}))
    assert envi.read_header(str(tmp_path / "a.dat"))["wavelength"] == ["1.5", "2.5", "3.5"]
    df = envi.read_cube(spark, str(tmp_path / "a.dat"))
    rows = {(r["line"], r["band"]): r["values"] for r in df.collect()}
    assert len(rows) == 12 and rows[(2, 1)] == cube[2, 1].tolist()
    part = df.filter((F.col("line") >= 1) & (F.col("line") < 3) & (F.col("band") == 2)).collect()
    assert sorted((r["line"], r["values"][0]) for r in part) == [(1, float(cube[1, 2, 0])), (2, float(cube[2, 2, 0]))]


def test_bil_round_trip_rounds_half_up(spark, tmp_path):
    rows = [(line, band, [line + 0.5, band + 0.25, 7.0]) for line in range(3) for band in range(2)]
    df = spark.createDataFrame(rows, "line int, band int, values array<double>")
    path = str(tmp_path / "out.bil")
    envi.write_bil(df, path, 12, 3, 3, 2)
    got = {(r["line"], r["band"]): r["values"] for r in envi.read_cube(spark, path).collect()}
    assert got[(1, 1)] == [2.0, 1.0, 7.0] and got[(0, 0)] == [1.0, 0.0, 7.0]
    with pytest.raises(ValueError):
        envi.write_bil(df.filter("line < 2"), path, 12, 3, 3, 2)


def test_wrong_size_is_refused(tmp_path):
    (tmp_path / "b.dat").write_bytes(b"123")
    (tmp_path / "b.hdr").write_text("ENVI\nsamples = 2\nlines = 1\nbands = 1\ndata type = 12\ninterleave = bil\n")
    with pytest.raises(ValueError):
        envi.Layout(str(tmp_path / "b.dat"))


def test_sbet(spark, tmp_path):
    r = np.zeros(3, sources.SBET)
    r["time"], r["lat"], r["heading"], r["wander"] = [1, 2, 3], np.radians(50), np.radians(-10), np.radians(5)
    r.tofile(tmp_path / "x.out")
    got = sources.read_sbet(spark, str(tmp_path / "x.out")).orderBy("time").collect()
    assert len(got) == 3 and got[0]["lat"] == pytest.approx(50) and got[0]["heading"] == pytest.approx(345)
    assert sources.sniff(str(tmp_path / "x.out")) == "sbet"


def test_binary_log_resynchronises():
    r = np.zeros(1, sources.BINARY_NAV)
    r["tag"], r["time"], r["roll"], r["lat"] = sources.NAV_TAG, 5.0, 150, 180_000_000
    got = sources.parse_binary_nav(b"\x01\x02" + r.tobytes() + b"\x00" + r.tobytes())
    assert got["roll"].tolist() == [1.5, 1.5] and got["lat"].tolist() == [50.0, 50.0]


def test_nmea(spark, tmp_path):
    (tmp_path / "a.nav").write_text("$GPGGA,010203.5,5130.00,N,00006.00,W,1,9,0.9,100.0,M,45.0,M,,*47\n$PRDID,1.5,-2.5,300.0\n$GPGGA,broken\n$SPTSMP2,77\n")
    r = sources.read_nmea(spark, str(tmp_path / "a.nav")).collect()
    assert len(r) == 1 and r[0]["lat"] == pytest.approx(51.5) and r[0]["lon"] == pytest.approx(-0.1)
    assert (r[0]["time"], r[0]["hei"], r[0]["roll"], r[0]["pitch"], r[0]["heading"]) == (3723.5, 145.0, -2.5, 1.5, 300.0)
    assert sources.read_syncs(spark, str(tmp_path / "a.nav")).count() == 1


def test_bad_pixels_and_qc(spark, tmp_path):
    (tmp_path / "f.bad").write_text("headerlines=3\nmethodA=x\nmethodB=y\n0 4 7 A,C\n1 4 7 B\n")
    assert [tuple(r) for r in sources.read_bad_pixels(spark, str(tmp_path / "f.bad")).collect()] == [(4, 7, 7)]
    (tmp_path / "v.bad").write_text("320 256 detector\n1 10 20 11 20 GON\n")
    assert [tuple(r) for r in sources.read_bad_pixels(spark, str(tmp_path / "v.bad")).collect()] == [(19, 9, 0)]
    (tmp_path / "qc").write_text("1 2\n9 9\n")
    with pytest.raises(Exception, match="QC list"):
        sources.read_qc_failures(spark, str(tmp_path / "qc"), 5, 5).collect()


def test_frame_stream_keeps_state(spark, tmp_path):
    schema = "flight int, line long, frame long"
    spark.createDataFrame([(1, 0, 65534), (1, 1, 65535)], schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame([(1, 2, 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = streaming.missing_frames_stream(lines).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["line"], r["delta"]) for r in spark.table("frames").collect() if r["delta"] is not None) in ([(1, 1), (2, 3)],)


def test_sol_takes_gps_time():
    r = np.zeros(2, sources.SOL)
    r["time_type"], r["times"], r["lat"], r["heading"] = [[3, 1], [1, 3]], [[1, 2], [3, 4]], np.radians(51), np.radians(-20)
    got = sources.parse_sol(r.tobytes())
    assert sources.SOL.itemsize == 184 and got["time"].tolist() == [2.0, 3.0] and got["heading"].tolist() == pytest.approx([340, 340])
    with pytest.raises(ValueError):
        sources.parse_sol(np.zeros(1, sources.SOL).tobytes())


def test_binary_syncs():
    r = np.zeros(1, sources.BINARY_NAV)
    r["tag"], r["time"], r["hei"] = sources.NAV_TAG, 7.25, 1234
    sync = np.array([sources.SYNC_TAG, 999, 0, 0, 0, 250, 0], "<i2").tobytes()
    content = r.tobytes() + sync + b"\x00" + sync + r.tobytes()
    assert sources.parse_binary_nav(content)["hei"].tolist() == [123.4, 123.4]
    assert sources.parse_binary_syncs(content)[["gps", "delay"]].values.tolist() == [[8.0, 0.25]]


def test_igm_round_trip(spark, tmp_path):
    from scanforge.sources import products

    rows = [(i, j, None if (i, j) == (1, 1) else float(i), float(j), 5.0) for i in range(2) for j in range(3)]
    igm = spark.createDataFrame(rows, "line int, sample int, x double, y double, z double")
    products.write_igm(igm, str(tmp_path / "a.igm"), 2, 3)
    got = sorted(tuple(r) for r in products.read_igm(spark, str(tmp_path / "a.igm")).collect())
    assert got == sorted(rows, key=lambda r: r[:2])
    items = products.sensor_items({"binning": ["2", "1"], "himg": ["3", "10"], "vimg": ["1", "4"], "tint": ["12.5"]})
    assert items["samples"] == [2, 9] and items["integration_time"] == 12.5 and items["spectral_binning"] == 2
