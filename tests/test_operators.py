import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanforge.functions import geodesy as g
from scanforge.operators import calibration as cal
from scanforge.operators import geolocation as geo
from scanforge.operators import navigation as nv
from scanforge.operators import resampling as rs


def test_ecef_round_trip(spark):
    p = spark.createDataFrame([(51.5, -0.1, 35.0), (-33.9, 151.2, 1200.0), (0.0, 179.9, 0.0), (80.0, 10.0, 5000.0)], "lat double, lon double, hei double")
    p = p.withColumns(dict(zip("xyz", g.llh_to_ecef(F.col("lat"), F.col("lon"), F.col("hei")))))
    back = p.select("lat", "lon", "hei", *[c.alias(n) for n, c in zip(("a", "b", "c"), g.ecef_to_llh(F.col("x"), F.col("y"), F.col("z")))]).collect()
    for r in back:
        assert (r["a"], r["b"], r["c"]) == pytest.approx((r["lat"], r["lon"], r["hei"]), abs=1e-6)


def test_geodesic_direct_and_inverse_agree(spark):
    lon, lat = g.geodesic_direct(F.lit(-1.0), F.lit(52.0), F.lit(8000.0), F.lit(37.0))
    p = spark.range(1).select(lon.alias("lon"), lat.alias("lat"))
    d, az, _ = g.geodesic_inverse(F.col("lon"), F.col("lat"), F.lit(0.0), F.lit(-1.0), F.lit(52.0), F.lit(0.0))
    r = p.select(d.alias("d"), az.alias("az")).first()
    assert r["d"] == pytest.approx(8000, abs=0.01) and r["az"] == pytest.approx(37, abs=1e-4)


def test_utm_of_a_known_point(spark):
    x, y = g.utm(F.lit(0.0), F.lit(3.0), 31)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(500000, abs=1e-6) and r["y"] == pytest.approx(0, abs=1e-6)
    x, y = g.utm(F.lit(48.8582), F.lit(2.2945))  # a tower in Paris
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(448251.8, abs=1) and r["y"] == pytest.approx(5411932.7, abs=1)


def test_smear_is_a_clamped_recurrence(spark):
    rng = np.random.default_rng(3)
    spectrum = rng.uniform(0, 50, 12).tolist()
    expected, total = [spectrum[0]], 0.0
    for x in spectrum[1:]:
        total += expected[-1]
        expected.append(max(0.0, x - 0.2 * total))
    got = spark.createDataFrame([(spectrum,)], "s array<double>").select(cal.smear_spectrum(F.col("s"), 0.2).alias("o")).first()["o"]
    assert got == pytest.approx(expected) and 0.0 in got


def test_gap_fill_inserts_dropped_lines(spark):
    lines = spark.createDataFrame([(1, 0, 65534), (1, 1, 65535), (1, 2, 0), (1, 3, 4)], "flight int, line long, frame long")
    rows = sorted((r["out_line"], r["mask"]) for r in cal.fill_gaps(lines).collect())
    assert rows == [(0, 0), (1, 0), (2, 0), (3, 16), (4, 16), (5, 16), (6, 0)]
    assert cal.missing_frames(lines).first()["missing"] == 3
    assert cal.fill_gaps(lines.limit(0)).count() == 0


def test_band_lists():
    assert cal.select_bands("ALL", 3) == [0, 1, 2] and cal.select_bands("3 1-2", 3) == [2, 0, 1]
    for wrong in ("2-2", "4", "0"):
        with pytest.raises(ValueError):
            cal.select_bands(wrong, 3)


def nav(spark, times, heading):
    return spark.createDataFrame([(1, float(t), 50 + t / 1000, 1.0, 100.0 + t, 0.0, 0.0, float(h)) for t, h in zip(times, heading)], "flight int, time double, lat double, lon double, hei double, roll double, pitch double, heading double")


def test_interpolation_crosses_slots_and_north(spark):
    n = nav(spark, [0, 10, 20, 100], [350, 359.5, 2, 4])
    scans = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 15.0), (1, 60.0), (1, 100.0), (1, 101.0)], "flight int, time double")
    got = {r["time"]: r for r in nv.interpolate(scans, n, slot=7.0).collect()}
    assert got[5.0]["hei"] == 105 and got[60.0]["hei"] == 160 and got[0.0]["hei"] == 100 and got[100.0]["hei"] == 200
    assert got[15.0]["heading"] == pytest.approx(0.75) and got[101.0]["hei"] is None


def test_brackets_equal_brute_force_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(nv, "ROWS_PER_TASK", 50)
    rng = np.random.default_rng(4)
    records = [(f, float(t), float(k), *[0.0] * 5) for f in range(2) for k, t in enumerate(rng.integers(0, 400, 150)) if not 100 < t < 200]
    asked = [(f, float(t)) for f in range(3) for t in range(-20, 420, 5)]
    n = spark.createDataFrame(records, "flight int, time double, lat double, lon double, hei double, roll double, pitch double, heading double")
    out = nv.bracket(spark.createDataFrame(asked, "flight int, time double"), n, slot=7.0)
    assert out.rdd.getNumPartitions() >= len(records + asked) // 50
    got = {(r["flight"], r["time"]): tuple(r[c] and (r[c]["time"], r[c]["lat"]) for c in ("before", "after")) for r in out.collect()}
    own = {f: sorted(r[1:3] for r in records if r[0] == f) for f in range(3)}
    assert got == {(f, t): (max((r for r in own[f] if r[0] < t), default=None), min((r for r in own[f] if r[0] >= t), default=None)) for f, t in asked}


def test_shifted_attitude_equals_interpolation_w9(spark, monkeypatch):
    monkeypatch.setattr(nv, "ROWS_PER_TASK", 1)
    n = nav(spark, [0, 10, 20, 100], [10, 20, 40, 80])
    scans = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 15.0)], "flight int, time double")
    out = nv.attitude_offset(scans, n, nv.interpolate(scans, n), 5.0)
    assert out.rdd.getNumPartitions() >= 6
    got = {r["time"]: (r["hei"], r["heading"]) for r in out.collect()}
    assert got == {0.0: (100.0, 15.0), 5.0: (105.0, 20.0), 15.0: (115.0, 40.0)}


def test_spline_is_exact_at_records_and_on_lines():
    t = np.array([0.0, 1, 2.5, 4, 7])
    assert nv.natural_spline(t, 3 * t + 1, np.array([0.5, 3, 6.5])) == pytest.approx([2.5, 10, 20.5])
    y = np.sin(t)
    assert nv.natural_spline(t, y, t) == pytest.approx(y)


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(1)
    rows = [(i, j, float(j + 0.2 * rng.random()), float(20 - i + 0.2 * rng.random())) for i in range(20) for j in range(20)]
    points = spark.createDataFrame(rows, "line long, sample long, x double, y double")
    values = points.select("line", "sample", F.lit(0).cast("long").alias("band"), (2 * F.col("x") - 3 * F.col("y") + 7).alias("value"))
    return points, values, rs.Grid(2.0, 18.0, 0.9, 0.9, 12, 12).cells(spark), rows


def test_nearest_equals_brute_force(field):
    points, _, cells, rows = field
    got = {}
    for r in rs.nearest(cells, points, 3, 2.0).collect():
        got.setdefault((r["row"], r["col"]), []).append((r["rank"], r["line"], r["sample"]))
    for c in cells.collect():
        best = sorted(((x - c["cx"]) ** 2 + (y - c["cy"]) ** 2, i, j) for i, j, x, y in rows)[:3]
        assert sorted(got[(c["row"], c["col"])]) == [(k + 1, i, j) for k, (_, i, j) in enumerate(best)]


@pytest.mark.parametrize("cells", [3, 200_000])
def test_tasks_keep_only_the_nearest(spark, cells):
    near = spark.range(600_000, numPartitions=1).select((F.col("id") % cells).alias("row"), F.lit(0).cast("long").alias("col"), (F.floor(F.col("id") / cells) * 7919 % 1009).cast("double").alias("d2"), F.col("id").alias("line"), F.lit(0).alias("sample"))
    got = rs.least(near, ["row", "col"], 2)
    plain = near.withColumn("rank", F.row_number().over(Window.partitionBy("row", "col").orderBy("d2", "line", "sample"))).filter("rank <= 2")
    assert got.count() == 2 * cells and got.exceptAll(plain).count() == 0


@pytest.mark.parametrize("name", ["nearest", "idw", "bilinear", "bilinearlev1", "cubic"])
def test_resamplers_keep_constants(field, name):
    points, values, cells, _ = field
    constant = values.withColumn("value", F.lit(5.0))
    arguments = (3, 3.0) if name == "idw" else (3.0,)
    got = [r["value"] for r in rs.RESAMPLERS[name](cells, points, constant, *arguments).collect()]
    assert len(got) == 144 and got == pytest.approx([5.0] * 144)


@pytest.mark.parametrize("resampler", [rs.map_bilinear, rs.map_quads])
def test_bilinear_keeps_linear_fields(field, resampler):
    points, values, cells, _ = field
    got = {(r["row"], r["col"]): r["value"] for r in resampler(cells, points, values, 3.0).collect()}
    for c in cells.collect():
        assert got[(c["row"], c["col"])] == pytest.approx(2 * c["cx"] - 3 * c["cy"] + 7, abs=1e-6)


def test_flat_terrain_equals_the_ellipsoid(spark):
    dem = spark.range(150 * 150).select(F.floor(F.col("id") / 150).alias("r"), (F.col("id") % 150).alias("c"), F.lit(100.0).alias("h"))
    scans = spark.createDataFrame([(0, 51.95, 0.05, 1500.0, 3.0, -2.0, 40.0)], "scan int, lat double, lon double, hei double, roll double, pitch double, heading double")
    views = spark.createDataFrame([(i, 0.0, float(4 * i - 8), 0.0) for i in range(5)], "sample int, rx double, ry double, rz double")
    terrain = {r["sample"]: r for r in geo.locate_on_dem(scans, views, dem, 0.0, 52.0, 0.001, 0.001).collect()}
    for r in geo.locate(geo.rays(scans, views), 100.0).collect():
        assert terrain[r["sample"]]["distance"] == pytest.approx(r["distance"], abs=0.01)
        assert terrain[r["sample"]]["lat"] == pytest.approx(r["pixel_lat"], abs=1e-6)
