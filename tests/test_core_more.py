"""Guards, product files, sensor dispatch, streams and other operators beside the registered queries."""

import json
import os
import pathlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scanforge.functions import geodesy as g
from scanforge.operators import calibration as cal
from scanforge.operators import geolocation as geo
from scanforge.operators import navigation as nv
from scanforge.operators import resampling as rs
from scanforge.sources import envi, nav, products
from scanforge.streaming import calibration as st


def cube(spark, lines=3, bands=4, samples=5, value="line * 100 + band * 10 + sample"):
    n = spark.range(lines * bands * samples)
    n = n.selectExpr(f"id div {bands * samples} as line", f"id div {samples} % {bands} as band", f"id % {samples} as sample")
    return n.selectExpr("*", f"cast({value} as double) as value")


# --- calibration ---------------------------------------------------------------------------------
def test_dark_start_moves_with_the_counter_w4():
    assert cal.boundary_shift(5, 1, 300011) == 0 and cal.boundary_shift(1, 5, 300011) == 1
    assert cal.boundary_shift(2, 2, 300011, force=True) == 0
    assert cal.boundary_shift(2, 2, 110001) == 1 and cal.boundary_shift(2, 2, 110001, force=True) == 1
    with pytest.raises(ValueError):
        cal.boundary_shift(2, 2, 300011)


def test_counter_must_rise_w1(spark):
    for frames in ([5, 5], [9, 7], [100, 40]):
        rows = [(1, k, f) for k, f in enumerate(frames)]
        with pytest.raises(PySparkException):
            cal.frame_deltas(spark.createDataFrame(rows, "flight int, line long, frame long")).collect()


def test_output_dimensions_p17(spark):
    lines = spark.createDataFrame([(1, 0, 65534), (1, 1, 65535), (1, 2, 2)], "flight int, line long, frame long")
    assert tuple(cal.output_dimensions(lines, 10, 29).first()) == (1, 5, 20)
    assert tuple(cal.output_dimensions(lines, 10, 29, gaps=False).first()) == (1, 3, 20)


def test_dark_over_the_largest_value_is_an_error_c2(spark):
    cells = cube(spark).withColumn("mask", F.lit(0))
    dark = spark.createDataFrame([(1, 1, 5000.0)], "band long, sample long, mean double")
    assert cal.remove_dark(cells, dark, 6000).count() == cells.count()
    with pytest.raises(PySparkException):
        cal.remove_dark(cells, dark, 4095).collect()


def test_integration_times_a4_and_binning_c6():
    cal.check_integration(20.0, 20.0)
    with pytest.raises(ValueError):
        cal.check_integration(20.0, 10.0)
    assert cal.binning_ratio(4, 2) == 2
    for wrong in ((3, 2), (1, 2), (2, 0)):
        with pytest.raises(ValueError):
            cal.binning_ratio(*wrong)


def test_shapes_must_agree_p15_j1(spark):
    level1, mask = cube(spark), cube(spark).selectExpr("line", "band", "sample", "cast(line = 1 as int) * 2 as mask")
    got = cal.mask_level1(level1, mask).filter("value > 0").select("line").distinct().collect()
    assert {r["line"] for r in got} == {0, 2}
    with pytest.raises(ValueError):
        cal.mask_level1(level1, mask.filter("sample < 4"))


def test_sensors_c7(spark):
    assert cal.sensor_of(110001).eagle and cal.fenix_raw_max("vnir", 2) == 8190 and cal.fenix_raw_max("swir", 2) == 65535
    with pytest.raises(ValueError):
        cal.sensor_of(1)
    cells = cube(spark, 2, 4, 5, "4095")
    bad = spark.createDataFrame([(2, 3)], "band long, sample long")
    eagle = cal.calibrate_sensor(cells, 100022, None, None, 20.0, 4, bad)
    assert eagle.filter(f"mask & {cal.BADPIXEL} <> 0 AND sample > 1").count() == 0 and eagle.filter(f"mask & {cal.SMEAR} <> 0").count() > 0
    hawk = cal.calibrate_sensor(cells, 300011, None, None, 20.0, 5, bad)
    # Samples are flipped: sample 3 of five is sample 1.
    assert {(r["band"], r["sample"]) for r in hawk.filter(f"mask & {cal.BADPIXEL} <> 0 AND band > 0").collect()} == {(2, 1)}
    with pytest.raises(ValueError):
        cal.calibrate_sensor(cells, 350005, None, None, 20.0, 5)
    assert cal.calibrate_sensor(cells, 350005, None, None, 20.0, 5, part="vnir").filter(f"mask = {cal.OVERFLOW}").count() > 0


def test_smear_of_null_empty_and_ragged_spectra(spark):
    rows = [(None,), ([],), ([5.0],), ([10.0, 10.0, 10.0],)]
    got = [r["o"] for r in spark.createDataFrame(rows, "s array<double>").coalesce(1).select(cal.smear_spectrum(F.col("s"), 0.1).alias("o")).collect()]
    assert got[:3] == [None, [], [5.0]] and got[3] == pytest.approx([10.0, 9.0, 8.1])


# --- navigation ----------------------------------------------------------------------------------
def test_time_guards_p16():
    assert list(nv.check_times(100.0, 90.0, 5000.0, 1.0)) == []
    assert len(list(nv.check_times(100.0, 90.0, 5000.0, 31.0))) == 1
    assert len(list(nv.check_times(86_000.0, 100.0, 200_000.0, 0.0))) == 1
    with pytest.raises(ValueError):
        list(nv.check_times(6000.0, 90.0, 5000.0, 0.0))


def test_spline_is_exact_on_lines_and_smooth_on_cubics():
    t = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    at = np.array([-1.0, 0.0, 0.5, 3.0, 7.0, 8.0])
    got = nv.natural_spline(t, np.stack([2 * t + 1, t * 0], 1), at)
    assert np.isnan(got[[0, 5]]).all() and got[1:5, 0] == pytest.approx(2 * at[1:5] + 1) and got[1:5, 1] == pytest.approx(0)


# --- geolocation ---------------------------------------------------------------------------------
def test_swath_area_a14_and_its_cells_s20(spark):
    flight = spark.createDataFrame([(52.0, -1.0, 1000.0, 0.0), (52.1, -0.9, 1100.0, -5.0)], "lat double, lon double, hei double, roll double")
    views = spark.createDataFrame([(0, 0.0, -20.0), (1, 0.0, 20.0)], "sample int, rx double, ry double")
    west, south, east, north = geo.dem_area(flight, views, 0.001, 0.001)
    reach = 1100 * np.tan(np.radians(25))
    assert north - 52.1 == pytest.approx(reach / 110_574 + 0.001) and 52.0 - south == pytest.approx(north - 52.1) and west < -1.0 and east > -0.9
    dem = spark.range(200 * 300).selectExpr("id div 300 as r", "id % 300 as c", "0d as h")
    kept = geo.select_dem(dem, (-1.0, 52.0, -0.9, 52.1), -1.1, 52.15, 0.001, 0.001).agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    # Snapped outward: at most a cell more on each side than the area's own.
    assert all(own - low in (0, 1) for own, low in zip((50, 100), (kept[0], kept[2]))) and all(high - own in (0, 1) for own, high in zip((150, 200), (kept[1], kept[3])))
    assert geo.dem_area(flight.limit(0), views, 0.001, 0.001) is None


def test_a_cell_without_height_is_an_error_s24(spark):
    dem = spark.createDataFrame([(0, 0, 5.0), (0, 1, None)], "r long, c long, h double")
    points = spark.createDataFrame([(0.0005, 51.9995)], "lon double, lat double")
    assert geo.height_at(points, dem.filter("c = 0"), 0.0, 52.0, 0.001, 0.001).first()["h"] == 5.0
    with pytest.raises(PySparkException):
        geo.height_at(points.withColumn("lon", F.lit(0.0015)), dem, 0.0, 52.0, 0.001, 0.001).collect()


def test_rotation_orders_f3(spark):
    def matrix(axis, angle):
        c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        return {"x": np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), "y": np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), "z": np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])}[axis]

    angles, v = {"x": 10.0, "y": -20.0, "z": 130.0}, np.array([0.3, -0.5, 0.8])
    for order in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx"):
        out = g.rotate(order, *[F.lit(angles[a]) for a in "xyz"], tuple(F.lit(float(x)) for x in v))
        got = spark.range(1).select(*[c.alias(n) for n, c in zip("abc", out)]).first()
        expected = matrix(order[0], angles[order[0]]) @ matrix(order[1], angles[order[1]]) @ matrix(order[2], angles[order[2]]) @ v
        assert tuple(got) == pytest.approx(tuple(expected))


# --- resampling ----------------------------------------------------------------------------------
def test_search_does_not_grow_with_bands(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 10, i % 10, *map(float, rng.uniform(0, 10, 2))) for i in range(100)]
    points = spark.createDataFrame(rows, "line long, sample long, x double, y double")
    values = [(l, s, b, float((l + s + b) % 3)) for l, s, *_ in rows for b in range(4)]
    level1 = spark.createDataFrame(values, "line long, sample long, band long, value double")
    cells = rs.Grid(0.0, 10.0, 1.0, 1.0, 10, 10).cells(spark)
    fast = rs.nearest_values(cells, points, level1, 3, 2.5, 0.0).select("row", "col", "band", "rank", "line", "sample", "value")
    slow = rs.nearest(cells, rs.with_values(points, level1, None, 0.0), 3, 2.5, ["band"]).select(fast.columns)
    assert sorted(fast.collect()) == sorted(slow.collect())
    assert rs.default_radius(3.0, 4.0) == 15.0


def test_extent_and_area(spark):
    p = spark.createDataFrame([(1.0, 5.0), (-9999.0, 2.0), (3.0, None)], "x double, y double")
    assert rs.extent(p) == (-9999.0, 2.0, 3.0, 5.0) and rs.extent(p.limit(0)) is None
    assert tuple(rs.array_limits(p, ("x",), -9999.0).first()) == (1.0, 3.0)
    grid = rs.sized_area(0.0, 10.0, 0.0, 6.0, 3, 5)
    assert (grid.x_size, grid.y_size, grid.rows, grid.cols) == (2.0, 2.0, 3, 5)


# --- files ---------------------------------------------------------------------------------------
def test_level1_products_k6_k13(spark, tmp_path):
    cells = cube(spark).withColumn("mask", (F.col("sample") % 3).cast("int")).withColumn("method", F.lit(8))
    fodis = spark.range(12).selectExpr("id div 4 as line", "id % 4 as band", "cast(id as double) as fodis")
    paths = products.write_level1(cells, str(tmp_path / "f"), 3, 5, 4, {"sensorid": 300011}, fodis)
    assert [p.removeprefix(str(tmp_path)) for p in paths] == ["/f.bil", "/f_mask.bil", "/f_mask-badpixelmethod.bil", "/f_FODIS.bil"]
    back = [envi.cells(envi.read_cube(spark, p)).collect() for p in paths]
    assert {(r["line"], r["band"], r["sample"]): r["value"] for r in back[0]} == {(r["line"], r["band"], r["sample"]): r["value"] for r in cells.collect()}
    assert {r["value"] for r in back[1]} == {0.0, 1.0, 2.0} and {r["value"] for r in back[2]} == {8.0} and sorted(r["value"] for r in back[3]) == [float(x) for x in range(12)]
    gains = spark.range(20).selectExpr("id div 5 as band", "id % 5 as sample", "id / 10 as gain")
    products.write_detector(gains, str(tmp_path / "g.cal"), "gain", 4, 5)
    assert sorted(round(r["value"], 6) for r in envi.cells(envi.read_cube(spark, str(tmp_path / "g.cal"))).collect()) == [round(x / 10, 6) for x in range(20)]


def test_navigation_products_k8_k9_k11(spark, tmp_path):
    rows = [(k, 86400.0 * 2 + k, 50.0 + k, -1.0, 100.127 + k, 0.5, 0.25, 359.0) for k in range(4)]
    df = spark.createDataFrame(rows, "scan long, " + ", ".join(f"{n} double" for n in products.NAV_BANDS))
    products.write_nav(df, str(tmp_path / "n.bil"), 4)
    got = sorted(products.read_nav(spark, str(tmp_path / "n.bil")).select("scan", "time", "hei").collect())
    assert [tuple(r) for r in got] == [(k, float(k), pytest.approx(100.12 + k)) for k in range(4)]
    products.write_quality(df.withColumn("quality", F.col("scan") * 3), str(tmp_path / "q.bil"), 4)
    assert sorted(r["value"] for r in envi.cells(envi.read_cube(spark, str(tmp_path / "q.bil"))).collect()) == [0.0, 3.0, 6.0, 9.0]
    air = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 4.0, None)], "line long, sample long, " + ", ".join(f"{n} double" for n in products.ATMOSPHERE_BANDS))
    products.write_atmosphere(air, str(tmp_path / "a.bil"), 1, 1)
    assert [r["value"] for r in sorted(envi.cells(envi.read_cube(spark, str(tmp_path / "a.bil"))).collect(), key=lambda r: r["band"])] == [1.0, 2.0, 3.0, 4.0, -9999.0]


def test_headers_of_joined_and_copied_files_s4_k7_k15():
    a = {"samples": ["5"], "bands": ["1"], "wavelength": ["400"], "sensorid": ["1"]}
    assert envi.joined_header([a, a | {"wavelength": ["500"]}]) == {"samples": ["5"], "bands": ["2"], "wavelength": ["400", "500"], "sensorid": ["1"]}
    with pytest.raises(ValueError):
        envi.joined_header([a, a | {"sensorid": ["2"]}])
    copied = envi.copied_header({"bands": ["2"], "wavelength": ["400", "500"], "sensorid": ["1"]}, reverse_bands=True)
    assert copied == {"wavelength": ["500", "400"], "sensorid": "1"}
    assert envi.map_info("osng", 1, 2, 3, 4)[0] == "British National Grid" and envi.map_info("utm", 1, 2, 3, 4, 30)[7] == "30"


def test_sub_sensors_s6_u1(spark):
    cells = cube(spark, 2, 6, 3)
    part = products.sub_sensor(cells, {"bands": (4, 5)})
    assert {(r["band"], r["value"]) for r in part.filter("line = 0 AND sample = 0").collect()} == {(0, 40.0), (1, 50.0)}
    assert products.join_sensors(part, part, 2).select("band").distinct().count() == 4
    assert [tuple(r) for r in products.frame_counters(cells).orderBy("line").collect()] == [(0, 0), (1, 100)]
    image, dark = products.split_dark(cells, {"autodarkstartline": ["1"]})
    assert image.select("line").distinct().count() == dark.select("line").distinct().count() == 1


def test_bad_pixel_ids_o9_s23(spark, tmp_path):
    text = ["; sensor 320 256", "1 3 7 3 7 GON", "2 4 8 4 8 GON"]
    (tmp_path / "c.bad").write_text("\n".join(text))
    assert {(r["band"], r["sample"]) for r in products.load_bad_pixels(spark, 300011, str(tmp_path / "c")).collect()} == {(6, 2), (7, 3)}
    assert products.load_bad_pixels(spark, 110001, str(tmp_path / "c")) is None and products.load_bad_pixels(spark, 300011, None) is None
    bands = spark.createDataFrame([(0, 7)], "band long, cal_band long")
    assert [(r["band"], r["sample"]) for r in products.load_bad_pixels(spark, 300011, str(tmp_path / "c"), bands).collect()] == [(0, 3)]
    (tmp_path / "d.bad").write_text("\n".join([text[0], text[1], "3 4 8 4 8 GON"]))
    with pytest.raises(ValueError):
        nav.read_bad_pixels(spark, str(tmp_path / "d.bad"))


def test_prescan_s25(spark, tmp_path):
    fix = "$GPGGA," + ",".join(["1"] * 14)
    (tmp_path / "a.nav").write_text("\n".join([fix, fix, "$GPGGA,short", "$GPZDA,120000,16,06,2010,00,00,*7", "$SPTSMP,1,2,3", "$SPTSMP2,5"]))
    (tmp_path / "b.nav").write_text("\n".join([fix, "$SPTSMP,1,2,3", "$SPTSMP,1,2,3"]))
    got = {pathlib.Path(r["file"]).name: tuple(r)[1:] for r in nav.prescan(spark, str(tmp_path / "*.nav")).collect()}
    assert got["b.nav"] == (1, 2, True, None)
    assert got["a.nav"][:3] == (2, 1, False)


# --- streams -------------------------------------------------------------------------------------
def streamed(spark, tmp_path, rows, schema, build):
    for k, part in enumerate(rows):
        (tmp_path / "in").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip([c.split()[0] for c in schema.split(", ")], r, strict=True))) for r in part))
        # Files come in order of their times.
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    name = f"out_{tmp_path.parent.name}_{tmp_path.name}".replace("-", "_")
    query = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_cells_are_calibrated_t1(spark, tmp_path):
    dark = spark.createDataFrame([(0, 0, 10.0)], "band long, sample long, mean double")
    gains = spark.createDataFrame([(0, 0, 2.0)], "band long, sample long, gain double")
    rows = [[(0, 0, 0, 40.0)], [(1, 0, 0, 5.0)]]
    got = streamed(spark, tmp_path, rows, "line long, band long, sample long, value double", lambda s: st.calibrate_stream(s, dark, gains, 1000.0))
    assert {(r["line"], r["value"], r["mask"]) for r in got} == {(0, 60.0, 0), (1, 0.0, 1)}


def test_streamed_lines_behind_are_dropped_or_raise_t2(spark, tmp_path):
    schema = "flight long, line long, frame long"
    rows = [[(1, 5, 100), (1, 6, 101)], [(1, 2, 97), (1, 7, 103)], [(1, 3, 98)], [(1, 8, 104)]]
    got = streamed(spark, tmp_path / "drop", rows, schema, st.missing_frames_stream)
    assert sorted((r["line"], r["delta"]) for r in got) == [(5, None), (6, 1), (7, 2), (8, 1)]
    with pytest.raises(Exception, match="line goes backwards"):
        streamed(spark, tmp_path / "raise", rows, schema, lambda s: st.missing_frames_stream(s, "raise"))


def test_streamed_scans_are_bracketed_t4_t5(spark, tmp_path):
    """Each scan has the nearest record on either side, whatever the batch it came in."""
    # One source with both kinds, so that scans and records come in the same batches.
    at = lambda s: f"2020-01-01T00:{s // 60:02.0f}:{s % 60:06.3f}Z"
    rows = [
        [("nav", at(10.0), 1.0), ("nav", at(10.6), 2.0), ("scan", at(10.8), 0.0), ("scan", at(10.6), 0.0)],
        [("nav", at(11.0), 3.0), ("nav", at(11.2), 4.0), ("scan", at(12.1), 0.0), ("scan", at(20.0), 0.0)],
        [("nav", at(300.0), 9.0), ("scan", at(300.0), 0.0)],
        [("nav", at(600.0), 9.0), ("scan", at(600.0), 0.0)],
    ]

    def build(s):
        s = s.withColumn("flight", F.lit(1))
        scans = s.filter("kind = 'scan'").select("flight", "ts")
        return st.bracket_stream(scans, s.filter("kind = 'nav'").select("flight", F.col("ts").alias("nav_ts"), "lat"))

    got = streamed(spark, tmp_path, rows, "kind string, ts timestamp, lat double", build)
    seen = {r["ts"].minute * 60 + r["ts"].second + r["ts"].microsecond / 1e6: (r["before"] and r["before"]["lat"], r["after"] and r["after"]["lat"]) for r in got}
    assert {k: v for k, v in seen.items() if k < 60} == {10.6: (1.0, 2.0), 10.8: (2.0, 3.0), 12.1: (4.0, None)}


def test_streamed_records_are_checked_t3_t6(spark, tmp_path):
    names = list(nv.PLAUSIBLE)
    schema = "flight long, " + ", ".join(f"{n} double" for n in names)
    row = lambda t, heading: (1, *[{"time": t, "heading": heading}.get(n, 1.0) for n in names])
    got = streamed(spark, tmp_path, [[row(0.0, 359.9), row(0.01, 0.2)], [row(0.02, 5.0), row(0.005, 5.0)]], schema, st.plausibility_stream)
    assert {(r["time"], r["quality"]) for r in got} >= {(0.0, 0), (0.01, 0), (0.02, 32)}
    assert 0.005 not in {r["time"] for r in got}
