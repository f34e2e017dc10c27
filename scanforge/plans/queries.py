"""Registered queries of the imaging operators, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import text as tx
from ..operators import calibration as cal
from ..operators import geolocation as geo
from ..operators import navigation as nv
from ..operators import resampling as rs
from ..sources import envi
from . import inputs as i

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RAW_MAX = 2400


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- dark frames ---------------------------------------------------------------------------------
DARK_MEAN = i.DARK + ", dm AS (SELECT band, sample, CASE WHEN band = 0 AND sample = 0 THEN 0::DOUBLE ELSE avg(value) END AS mean FROM dark GROUP BY band, sample)"


@query("WITH " + DARK_MEAN + " SELECT band, sample, round(mean, 6) AS mean FROM dm")
def dark_mean_a1(spark, sf):
    return rounded(cal.dark_mean(i.dark(spark, sf)))


@query("WITH " + i.DARK + " SELECT band, sample, round(coalesce(stddev_samp(value), 0), 6) AS std FROM dark GROUP BY band, sample")
def dark_std_a2(spark, sf):
    return rounded(cal.dark_std(i.dark(spark, sf)))


@query("WITH " + i.DARK + """, s AS (SELECT *, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS sd, count(*) OVER w AS n FROM dark WINDOW w AS (PARTITION BY band, sample))
SELECT band, sample, CASE WHEN band = 0 AND sample = 0 THEN 0 ELSE round(avg(value), 6) END AS mean, count(*) AS kept, count(*) < any_value(n) / 2 AS few
FROM s WHERE abs(value - m) <= sd GROUP BY band, sample""")  # fmt: skip
def dark_refined_a3(spark, sf):
    # One deviation, so that some frames are cut.
    return rounded(cal.dark_refined(i.dark(spark, sf), sigmas=1.0))


# --- the calibration kernel ----------------------------------------------------------------------
FLAGGED = DARK_MEAN + f""", bad AS (SELECT DISTINCT p_partkey % 997 AS band, p_partkey % 16 AS sample FROM part), qc AS (SELECT DISTINCT s_suppkey * 7 % 97 + 20 AS band, s_suppkey % 16 AS sample FROM supplier), f0 AS (
  SELECT c.line, c.sample, c.band, c.value, d.mean, c.band = 0 AND c.sample IN (0, 1) AS counter, c.value = {RAW_MAX} AS over, d.mean IS NOT NULL AND c.value <= d.mean AS under
  FROM cells c LEFT JOIN dm d USING (band, sample)
), f1 AS (
  SELECT *, coalesce(max((over AND NOT counter)::INTEGER) OVER (PARTITION BY line, sample ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smeared FROM f0
), flagged AS (
  SELECT line, sample, band, CASE WHEN counter THEN 0 WHEN over THEN value WHEN under THEN 0 ELSE value END AS value,
         (CASE WHEN counter THEN 4 WHEN over THEN 2 WHEN under THEN 1 ELSE 0 END | smeared * 8 | CASE WHEN b.band IS NOT NULL THEN 4 ELSE 0 END | CASE WHEN q.band IS NOT NULL THEN 64 ELSE 0 END)::INTEGER AS mask
  FROM f1 LEFT JOIN bad b USING (band, sample) LEFT JOIN qc q USING (band, sample)
)"""


def bad_pixels(spark, sf):
    p = i.table(spark, sf, "part")
    return p.select((F.col("p_partkey") % 997).alias("band"), (F.col("p_partkey") % 16).alias("sample"))


def qc_pixels(spark, sf):
    s = i.table(spark, sf, "supplier")
    return s.select((F.col("s_suppkey") * 7 % 97 + 20).alias("band"), (F.col("s_suppkey") % 16).alias("sample"))


def flagged(spark, sf):
    return cal.flag_pixels(i.cells(spark, sf).drop("label"), cal.dark_mean(i.dark(spark, sf)), RAW_MAX, bad_pixels(spark, sf), qc_pixels(spark, sf), eagle=True)


@query("WITH " + FLAGGED + " SELECT line, sample, band, value, mask FROM flagged")
def flag_pixels_c1(spark, sf):
    return flagged(spark, sf).select("line", "sample", "band", "value", "mask")


UNDARK = FLAGGED + """, undark AS (
  SELECT f.line, f.sample, f.band, CASE WHEN f.value <> 0 AND f.value < 65535 THEN greatest(f.value - coalesce(d.mean, 0), 0) ELSE f.value END AS value,
         CASE WHEN f.value <> 0 AND f.value < 65535 AND f.value - coalesce(d.mean, 0) <= 0 THEN f.mask | 1 ELSE f.mask END AS mask
  FROM flagged f LEFT JOIN dm d USING (band, sample))"""


@query("WITH " + UNDARK + " SELECT line, sample, band, round(value, 6) AS value, mask FROM undark")
def remove_dark_c2(spark, sf):
    return rounded(cal.remove_dark(flagged(spark, sf), cal.dark_mean(i.dark(spark, sf))))


SMEARED = """, r AS (
  SELECT line, sample, band, value, mask, value AS out, 0::DOUBLE AS s FROM {source} WHERE band = 0
  UNION ALL
  SELECT x.line, x.sample, x.band, x.value, x.mask, greatest(x.value - {factor} * (r.s + r.out), 0), r.s + r.out FROM r JOIN {source} x ON x.line = r.line AND x.sample = r.sample AND x.band = r.band + 1
), smeared AS (SELECT line, sample, band, out AS value, CASE WHEN out = 0 AND value > 0 THEN mask | 1 ELSE mask END AS mask FROM r)"""


@query("WITH RECURSIVE " + i.CELLS + ", plain AS (SELECT line, sample, band, value, 0 AS mask FROM cells)" + SMEARED.format(source="plain", factor="0.05::DOUBLE") + " SELECT line, sample, band, round(value, 6) AS value, mask FROM smeared")
def smear_c3(spark, sf):
    return rounded(cal.smear_correct(i.cells(spark, sf).select("line", "sample", "band", "value", F.lit(0).alias("mask")), 0.05))


@query("WITH " + i.CELLS + ", " + i.GAINS + """ SELECT line, sample, band, round(CASE WHEN value <> 0 AND value <> 65535 THEN least(value * gain * (1000::DOUBLE / 30), 65535) ELSE value END, 6) AS value,
CASE WHEN value <> 0 AND value <> 65535 AND value * gain * (1000::DOUBLE / 30) >= 65535 THEN 2 ELSE 0 END AS mask FROM cells LEFT JOIN gains USING (band, sample)""")  # fmt: skip
def apply_gain_c4(spark, sf):
    return rounded(cal.apply_gains(i.cells(spark, sf).select("line", "sample", "band", "value", F.lit(0).alias("mask")), i.gains(spark), 30.0))


@query("WITH " + i.GAINS + " SELECT band // 2 AS band, sample // 4 AS sample, round(sum(gain) / 64, 6) AS gain FROM gains GROUP BY 1, 2")
def gain_binning_a7(spark, sf):
    return rounded(cal.bin_gains(i.gains(spark), 2, 4))


WAVES = "waves AS (SELECT b AS band, 400 + b * 2.5::DOUBLE AS wavelength FROM range(256) t(b))"


def waves(spark, n=256, start=400.0, step=2.5):
    return spark.range(n).select(F.col("id").alias("band"), (F.lit(start) + F.col("id") * step).alias("wavelength"))


@query("WITH " + WAVES + " SELECT band // 4 AS band, round(avg(wavelength), 6) AS wavelength FROM waves GROUP BY 1")
def wavelength_bin_a8(spark, sf):
    return rounded(cal.bin_wavelengths(waves(spark), 4))


@query("""WITH raw AS (SELECT p_partkey AS band, p_retailprice AS wavelength FROM part), c AS (SELECT p_partkey AS cal_band, p_retailprice + (p_partkey % 3) * 0.004::DOUBLE AS w FROM part)
SELECT band, min(cal_band) AS cal_band FROM raw LEFT JOIN c ON abs(wavelength - w) <= 0.006::DOUBLE GROUP BY band""")
def wavelength_match_j6(spark, sf):
    p = i.table(spark, sf, "part")
    cal_side = p.select(F.col("p_partkey").alias("band"), (F.col("p_retailprice") + (F.col("p_partkey") % 3) * 0.004).alias("wavelength"))
    return cal.match_wavelengths(p.select(F.col("p_partkey").alias("band"), F.col("p_retailprice").alias("wavelength")), cal_side)


@query("WITH " + i.CELLS + " SELECT line, band, round(least(coalesce(avg(CASE WHEN sample >= 2 AND sample < 9 AND value <> 0 THEN value END), 0), 65535), 6) AS fodis FROM cells GROUP BY line, band")
def fodis_a5(spark, sf):
    return rounded(cal.average_fodis(i.cells(spark, sf), 2, 9))


@query("WITH " + i.CELLS + " SELECT line, sample, 63 - band AS band, value FROM cells")
def flip_bands_p9(spark, sf):
    return cal.flip(i.cells(spark, sf).drop("label"), "band", 64)


@query("WITH " + i.CELLS + " SELECT line, 15 - sample AS sample, band, value FROM cells")
def flip_samples_p9(spark, sf):
    return cal.flip(i.cells(spark, sf).drop("label"), "sample", 16)


@query("WITH " + i.CELLS + ", w AS (SELECT * FROM (VALUES (4, 0), (5, 1), (6, 2), (40, 3)) t(band, out_band)) SELECT line, sample, out_band, value FROM cells JOIN w USING (band)")
def band_select_p2(spark, sf):
    order = spark.createDataFrame([(b, n) for n, b in enumerate(cal.select_bands("5-7 41", 64))], "band long, out_band int")
    return i.cells(spark, sf).join(F.broadcast(order), "band").select("line", "sample", "out_band", "value")


@query("WITH " + i.CELLS + " SELECT line, sample, band, value FROM cells WHERE line >= 5 AND line < 20")
def line_select_p1(spark, sf):
    return cal.select_lines(i.cells(spark, sf), 5, 20).drop("label")


@query("WITH " + i.CELLS + " SELECT line, sample - 3 AS sample, band, value FROM cells WHERE sample BETWEEN 3 AND 11")
def sample_crop_p3(spark, sf):
    return cal.crop_samples(i.cells(spark, sf), 3, 11).drop("label")


@query("WITH " + i.CELLS + " SELECT line - 4 AS line, sample, band, value FROM cells WHERE line BETWEEN 4 AND 9")
def trim_lines_p14(spark, sf):
    return cal.trim_lines(i.cells(spark, sf), 4, 9).drop("label")


@query("WITH " + i.POINTS + " SELECT line, sample, x, y FROM points WHERE x > 0 AND x < 5000 AND y > 2000 AND y < 8000")
def area_filter_p4(spark, sf):
    return rs.select_area(i.points(spark, sf), 0, 5000, 2000, 8000).drop("z")


@query("WITH " + i.POINTS + " SELECT line, sample, x, y FROM points WHERE line NOT IN (3, 1, 17)")
def ignore_scan_p5(spark, sf):
    return rs.without_lines(i.points(spark, sf), [3, 1, 17]).drop("z")


@query("WITH " + i.CELLS + ", l AS (SELECT DISTINCT s_suppkey % 40 AS line FROM supplier WHERE s_acctbal < 0) SELECT line, sample, band, CASE WHEN l.line IS NOT NULL THEN 0 ELSE value END AS value, CASE WHEN l.line IS NOT NULL THEN 32 ELSE 0 END AS mask FROM cells LEFT JOIN l USING (line)")
def corrupt_scan_p7(spark, sf):
    lines = i.table(spark, sf, "supplier").filter("s_acctbal < 0").select((F.col("s_suppkey") % 40).alias("line"))
    return cal.override_corrupt(i.cells(spark, sf).withColumn("mask", F.lit(0)).drop("label"), lines)


@query("WITH " + FLAGGED + " SELECT line, sample, band, CASE WHEN mask & 127 <> 0 THEN 0 ELSE value END AS value FROM flagged")
def mask_apply_p8(spark, sf):
    return cal.apply_mask(flagged(spark, sf)).select("line", "sample", "band", "value")


@query("WITH " + FLAGGED + """ SELECT line, sample, band, CASE WHEN mask & 11 <> 0 OR (mask & 4 <> 0 AND (CASE WHEN (band + sample) % 3 = 0 THEN 1 ELSE 8 END) & 9 & 1 <> 0) THEN 0 ELSE value END AS value FROM flagged""")
def mask_method_p8(spark, sf):
    method = F.when((F.col("band") + F.col("sample")) % 3 == 0, 1).otherwise(8)
    return cal.apply_mask(flagged(spark, sf).withColumn("method", method), flags=15, methods=1).select("line", "sample", "band", "value")


@query("WITH m AS (SELECT l_orderkey // 100 AS line, l_linenumber AS sample, l_partkey % 8 AS band, (1 << (l_suppkey % 7))::INTEGER AS mask FROM lineitem) SELECT line, sample, band, bit_or(mask) AS mask FROM m GROUP BY ALL")
def mask_or_a17(spark, sf):
    item = i.table(spark, sf, "lineitem")
    bit = F.expr("shiftleft(1, cast(l_suppkey % 7 as int))")
    return cal.merge_masks(item.select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("line"), F.col("l_linenumber").alias("sample"), (F.col("l_partkey") % 8).alias("band"), bit.alias("mask")))


@query("SELECT p_size AS band, p_partkey % 16 AS sample, bit_or(1 << ((p_partkey % 6)::INTEGER)) AS method FROM part GROUP BY ALL")
def method_or_a16(spark, sf):
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCDEF"]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return cal.merge_methods(i.table(spark, sf, "part").select(F.col("p_size").alias("band"), (F.col("p_partkey") % 16).alias("sample"), letter.alias("method")))


@query("WITH " + i.CELLS + " SELECT line FROM cells WHERE band = 0 AND sample = 0 AND line % 5 = 2 GROUP BY line")
def dropped_scans_a18(spark, sf):
    return cal.dropped_scans(i.cells(spark, sf).withColumn("mask", F.when(F.col("line") % 5 == 2, 17).otherwise(1)))


LINES = """lines AS (SELECT o_orderkey // 5000 AS flight, o_orderkey AS line, (o_orderkey % 5000 + 63000) % 65536 AS frame FROM orders WHERE o_orderkey % 7 <> 0)"""


def lines(spark, sf):
    return i.table(spark, sf, "orders").filter("o_orderkey % 7 <> 0").select(F.floor(F.col("o_orderkey") / 5000).cast("long").alias("flight"), F.col("o_orderkey").alias("line"), ((F.col("o_orderkey") % 5000 + 63000) % 65536).alias("frame"))


DELTAS = LINES + """, d0 AS (SELECT *, frame - lag(frame) OVER (PARTITION BY flight ORDER BY line) AS step FROM lines),
d AS (SELECT flight, line, frame, CASE WHEN step <= -65533 THEN step + 65536 ELSE step END AS delta FROM d0)"""


@query("WITH " + DELTAS + " SELECT * FROM d")
def frame_delta_w1(spark, sf):
    return cal.frame_deltas(lines(spark, sf))


@query("WITH " + DELTAS + " SELECT flight, coalesce(sum(CASE WHEN delta > 1 THEN delta - 1 END), 0)::BIGINT AS missing FROM d GROUP BY flight")
def missing_total_a10(spark, sf):
    return cal.missing_frames(lines(spark, sf))


@query("WITH " + DELTAS + """, o AS (SELECT *, sum(CASE WHEN delta IS NULL THEN 0 ELSE greatest(delta, 1) END) OVER (PARTITION BY flight ORDER BY line)::BIGINT AS out_line FROM d)
SELECT flight, line, out_line, 0 AS mask FROM o UNION ALL SELECT flight, NULL, unnest(range(out_line - delta + 1, out_line)), 16 FROM o WHERE delta > 1""")
def gap_fill_w2(spark, sf):
    return cal.fill_gaps(lines(spark, sf))


CALIBRATED = UNDARK + ", " + i.GAINS + SMEARED.format(source="undark", factor="0.002::DOUBLE") + """, calibrated AS (
  SELECT line, sample, 63 - band AS band, CASE WHEN value <> 0 AND value <> 65535 THEN least(value * gain * (1000::DOUBLE / 30), 65535) ELSE value END AS value,
         CASE WHEN value <> 0 AND value <> 65535 AND value * gain * (1000::DOUBLE / 30) >= 65535 THEN mask | 2 ELSE mask END AS mask
  FROM smeared LEFT JOIN gains USING (band, sample))"""


def calibrated(spark, sf):
    dark = cal.dark_mean(i.dark(spark, sf))
    return cal.calibrate(i.cells(spark, sf).drop("label"), dark, i.gains(spark), RAW_MAX, 30.0, bad_pixels(spark, sf), qc_pixels(spark, sf), True, 0.002, "band", 64)


@query("WITH RECURSIVE " + CALIBRATED + " SELECT line, sample, band, round(value, 5) AS value, mask FROM calibrated")
def calibrate_pipeline(spark, sf):
    return rounded(calibrated(spark, sf), 5)


@query("WITH RECURSIVE " + CALIBRATED + " SELECT band, count(*) AS n, sum((mask <> 0)::INTEGER)::BIGINT AS flagged, round(avg(value), 4) AS radiance FROM calibrated GROUP BY band")
def band_radiance(spark, sf):
    c = calibrated(spark, sf)
    return rounded(c.groupBy("band").agg(F.count("*").alias("n"), F.sum((F.col("mask") != 0).cast("long")).alias("flagged"), F.avg("value").alias("radiance")), 4)


# --- navigation ----------------------------------------------------------------------------------
@query("WITH " + i.NAV + """, l AS (SELECT *, time - lag(time) OVER w AS dt, lat - lag(lat) OVER w AS dlat, lon - lag(lon) OVER w AS dlon, hei - lag(hei) OVER w AS dhei, roll - lag(roll) OVER w AS droll,
  pitch - lag(pitch) OVER w AS dpitch, abs(heading - lag(heading) OVER w) AS dhead FROM nav WINDOW w AS (PARTITION BY flight ORDER BY time))
SELECT flight, event_id, ((CASE WHEN abs(dt) > 0.05 THEN 64 ELSE 0 END) + (CASE WHEN abs(dlat) > 0.0001 THEN 1 ELSE 0 END) + (CASE WHEN abs(dlon) > 0.0001 THEN 2 ELSE 0 END) + (CASE WHEN abs(dhei) > 0.5 THEN 4 ELSE 0 END)
 + (CASE WHEN abs(droll) > 0.12 THEN 8 ELSE 0 END) + (CASE WHEN abs(dpitch) > 1 THEN 16 ELSE 0 END) + (CASE WHEN least(dhead, 360 - dhead) > 1 THEN 32 ELSE 0 END))::INTEGER AS quality FROM l""")  # fmt: skip
def nav_plausibility_w5(spark, sf):
    return nv.plausibility(i.nav(spark, sf)).select("flight", "event_id", "quality")


@query("WITH " + i.NAV + """, s AS (SELECT flight, event_id, hei, heading, row_number() OVER w AS p, count(*) OVER (PARTITION BY flight) AS n, lag(hei) OVER w AS h1, lead(hei) OVER w AS h2,
  lag(heading) OVER w - heading AS a, lead(heading) OVER w - heading AS b FROM nav WINDOW w AS (PARTITION BY flight ORDER BY time)),
u AS (SELECT *, heading + 0.25 * (CASE WHEN a > 180 THEN a - 360 WHEN a < -180 THEN a + 360 ELSE a END) + 0.25 * (CASE WHEN b > 180 THEN b - 360 WHEN b < -180 THEN b + 360 ELSE b END) AS hd FROM s)
SELECT flight, event_id, round(CASE WHEN p > 3 AND p <= n - 3 THEN h1 * 0.25 + hei * 0.5 + h2 * 0.25 ELSE hei END, 6) AS hei,
 round(CASE WHEN p > 3 AND p <= n - 3 THEN CASE WHEN hd < 0 THEN hd + 360 WHEN hd >= 360 THEN hd - 360 ELSE hd END ELSE heading END, 6) AS heading FROM u""")  # fmt: skip
def nav_smooth_w6(spark, sf):
    return rounded(nv.smooth(i.nav(spark, sf), 5, ["hei", "heading"]).select("flight", "event_id", "hei", "heading"))


LINEAR = """, j AS (SELECT s.*, p.time AS pt, p.lat AS plat, p.hei AS phei, p.heading AS phd, n.time AS nt, n.lat AS nlat, n.hei AS nhei, n.heading AS nhd
  FROM {scans} s ASOF LEFT JOIN nav p ON s.flight = p.flight AND s.time > p.time ASOF LEFT JOIN nav n ON s.flight = n.flight AND s.time <= n.time),
k AS (SELECT *, (time - pt) / (nt - pt) AS f, CASE WHEN nhd - phd > 350 THEN nhd - 360 WHEN phd - nhd > 350 THEN nhd + 360 ELSE nhd END AS nh FROM j),
v AS (SELECT *, phd + (nh - phd) * f AS h FROM k),
linear AS (SELECT flight, scan, time, CASE WHEN nt = time THEN nlat ELSE plat + (nlat - plat) * f END AS lat, CASE WHEN nt = time THEN nhei ELSE phei + (nhei - phei) * f END AS hei,
 CASE WHEN nt = time THEN nhd WHEN h < 0 THEN h + 360 WHEN h >= 360 THEN h - 360 ELSE h END AS heading FROM v)"""


@query("WITH " + i.SCANS + LINEAR.format(scans="scans") + " SELECT flight, scan, round(lat, 6) AS lat, round(hei, 5) AS hei, round(heading, 5) AS heading FROM linear")
def nav_linear_w7(spark, sf):
    out = nv.interpolate(i.scans(spark, sf), i.nav(spark, sf))
    return out.select("flight", "scan", F.round("lat", 6).alias("lat"), F.round("hei", 5).alias("hei"), F.round("heading", 5).alias("heading"))


@query("WITH " + i.NAV + """, b AS (SELECT flight, min(time) AS a, max(time) AS z, count(*) AS n FROM nav GROUP BY flight HAVING count(*) > 1), c AS (SELECT *, (z - a) / (n - 1) AS sep FROM b),
d AS (SELECT *, n - ceil(10000 / sep)::BIGINT AS keep FROM c WHERE n - ceil(10000 / sep) > 0), s AS (SELECT flight, unnest(range(keep))::INTEGER AS scan, a + 10000::DOUBLE AS a, sep FROM d), t AS (SELECT flight, scan, a + scan * sep AS time FROM s)""" + LINEAR.format(scans="t") + " SELECT flight, scan, round(time, 4) AS time, round(lat, 6) AS lat, round(hei, 5) AS hei FROM linear")  # fmt: skip
def nav_shift_w11(spark, sf):
    nav = i.nav(spark, sf)
    out = nv.interpolate(nv.shift_times(nav, 10000.0), nav)
    return out.select("flight", "scan", F.round("time", 4).alias("time"), F.round("lat", 6).alias("lat"), F.round("hei", 5).alias("hei"))


@query("WITH " + i.NAV + " SELECT flight, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, min(hei) AS min_hei, max(hei) AS max_hei, min(roll) AS min_roll, max(roll) AS max_roll FROM nav GROUP BY flight")
def nav_limits_s17(spark, sf):
    return nv.limits(i.nav(spark, sf))


@query("WITH " + i.NAV + """, s AS (SELECT DISTINCT flight, floor(min(time) OVER (PARTITION BY flight)) + 40000 AS start FROM nav),
x AS (SELECT flight, start, event_id AS seq, floor(time) AS gps, trunc(abs(floor(time) - start))::BIGINT AS gap FROM s JOIN nav USING (flight))
SELECT flight, start, seq, gps, gap FROM (SELECT *, row_number() OVER (PARTITION BY flight, start ORDER BY gap, seq) AS r FROM x) WHERE r = 1""")
def nearest_sync_j9(spark, sf):
    nav = i.nav(spark, sf)
    start = nav.groupBy("flight").agg((F.floor(F.min("time")) + 40000).cast("double").alias("start"))
    return nv.nearest_sync(start, nav.select("flight", F.col("event_id").alias("seq"), F.floor("time").cast("double").alias("gps")))


@query("""WITH sy AS (SELECT o_custkey % 20 AS flight, o_orderkey * 10 AS frame, o_orderkey % 997 AS gps FROM orders), f AS (SELECT DISTINCT l_suppkey % 20 AS flight, l_orderkey * 10 + 3 AS frame FROM lineitem)
SELECT f.flight, f.frame, sy.frame AS sync_frame, sy.gps FROM f ASOF LEFT JOIN sy ON f.flight = sy.flight AND f.frame >= sy.frame""")
def persec_sync_j10(spark, sf):
    syncs = i.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("flight"), (F.col("o_orderkey") * 10).alias("frame"), (F.col("o_orderkey") % 997).alias("gps"))
    frames = i.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("flight"), (F.col("l_orderkey") * 10 + 3).alias("frame")).distinct()
    return nv.sync_of_frames(frames, syncs)


@query("""SELECT o_orderkey, CASE WHEN d >= DATE '2017-01-01' THEN 18 WHEN d >= DATE '2015-07-01' THEN 17 WHEN d >= DATE '2012-07-01' THEN 16 WHEN d >= DATE '2009-01-01' THEN 15 ELSE 14 END AS seconds
FROM (SELECT o_orderkey, (o_orderdate + INTERVAL 15 YEAR)::DATE AS d FROM orders)""")
def leap_seconds_j11(spark, sf):
    day = F.expr("cast(o_orderdate + interval 15 years as date)")
    return i.table(spark, sf, "orders").select("o_orderkey", nv.leap_seconds(day).alias("seconds"))


@query("SELECT flight, unnest(range(n))::INTEGER AS scan, round(1000.5 + (unnest(range(n)) + 3) / fps, 6) AS time FROM (SELECT s_suppkey AS flight, 5 + s_nationkey AS n, 20 + s_nationkey::DOUBLE AS fps FROM supplier)")
def scan_times_w10(spark, sf):
    s = i.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("flight"), F.lit(1000.5).alias("start"), (20 + F.col("s_nationkey")).cast("double").alias("fps"), (5 + F.col("s_nationkey")).alias("lines"), F.lit(3).alias("crop"))
    return rounded(nv.scan_times(s))


@query("WITH " + i.NAV + ", b AS (SELECT flight, event_id, (time::BIGINT) % 86400 AS second, time FROM nav), l AS (SELECT *, (second < lag(second) OVER (PARTITION BY flight ORDER BY event_id))::INTEGER AS back FROM b) SELECT flight, event_id, (second + 86400 * coalesce(sum(back) OVER (PARTITION BY flight ORDER BY event_id), 0))::BIGINT AS time FROM l")
def day_rollover_w13(spark, sf):
    n = i.nav(spark, sf).select("flight", F.col("event_id").alias("seq"), (F.rint("time").cast("long") % 86400).alias("second"))
    return nv.unroll_days(n).select("flight", F.col("seq").alias("event_id"), "time")


@query("SELECT event_id, (dayofweek(ts) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS sow FROM events")
def sec_of_week_f21(spark, sf):
    e = i.table(spark, sf, "events")
    return e.select("event_id", tx.seconds_of_week(F.to_date("ts"), F.date_format("ts", "HH mm ss")).alias("sow"))


@query("SELECT event_id, coalesce(TRY_CAST(nullif(regexp_replace(props, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS number, length(props) - length(replace(props, '\"', '')) AS quotes, len(string_split(event_type, 'c')) AS parts, lpad(event_type, 12, '*') AS padded, upper(event_type) AS name, coalesce(TRY_CAST(event_type AS BIGINT), 0) AS bad FROM events")
def text_functions_f19(spark, sf):
    e = i.table(spark, sf, "events")
    return e.select("event_id", tx.to_integer(tx.remove_all_but(F.col("props"), "0-9")).alias("number"), tx.occurrences(F.col("props"), '"').cast("long").alias("quotes"), tx.item_count(F.col("event_type"), "c").cast("long").alias("parts"), tx.pad(F.col("event_type"), "*", 12).alias("padded"), F.upper("event_type").alias("name"), tx.to_integer(F.col("event_type")).alias("bad"))


@query("SELECT c_custkey, round((CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END) * (floor(v / 100) + (v - floor(v / 100) * 100) / 60), 8) AS degrees FROM (SELECT *, abs(c_acctbal) % 9000::DOUBLE AS v FROM customer)")
def nmea_degrees_f22(spark, sf):
    c = i.table(spark, sf, "customer")
    value = F.abs("c_acctbal") % 9000.0
    return rounded(c.select("c_custkey", tx.nmea_degrees(value, F.when(F.col("c_nationkey") % 2 == 0, "S").otherwise("N")).alias("degrees")), 8)


# --- geodesy -------------------------------------------------------------------------------------
LLH = "llh AS (SELECT c_custkey AS id, (c_custkey * 37) % 160 - 80::DOUBLE AS lat, (c_custkey * 53) % 340 - 170::DOUBLE AS lon, c_acctbal AS hei, (c_custkey % 11)::DOUBLE AS roll, (c_custkey % 7)::DOUBLE AS pitch, (c_custkey % 360)::DOUBLE AS heading FROM customer)"
CONSTANTS = f"{g.A!r}::DOUBLE AS a, {g.B!r}::DOUBLE AS b, {g.EE!r}::DOUBLE AS ee"


def llh(spark, sf):
    k = F.col("c_custkey")
    return i.table(spark, sf, "customer").select(k.alias("id"), ((k * 37) % 160 - 80).cast("double").alias("lat"), ((k * 53) % 340 - 170).cast("double").alias("lon"), F.col("c_acctbal").alias("hei"), (k % 11).cast("double").alias("roll"), (k % 7).cast("double").alias("pitch"), (k % 360).cast("double").alias("heading"))


ECEF = LLH + f", q AS (SELECT *, {CONSTANTS}, sqrt(1 - {g.EE!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) AS c FROM llh), ecef AS (SELECT *, (a / c + hei) * cos(radians(lat)) * cos(radians(lon)) AS x, (a / c + hei) * cos(radians(lat)) * sin(radians(lon)) AS y, (a * (1 - ee) / c + hei) * sin(radians(lat)) AS z FROM q)"


def ecef(spark, sf):
    p = llh(spark, sf)
    return p.withColumns(dict(zip("xyz", g.llh_to_ecef(F.col("lat"), F.col("lon"), F.col("hei")), strict=True)))


@query("WITH " + ECEF + " SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM ecef")
def llh_to_ecef_f1(spark, sf):
    return rounded(ecef(spark, sf).select("id", "x", "y", "z"), 4)


HEIKKINEN = """, h1 AS (SELECT {keys}, a, b, ee, x, y, z, x * x + y * y AS rr, 54 * b * b * z * z AS f FROM {source}), h2 AS (SELECT *, rr + (1 - ee) * z * z - ee * (a * a - b * b) AS g FROM h1), h3 AS (SELECT *, ee * ee * f * rr / (g * g * g) AS c FROM h2),
h4 AS (SELECT *, cbrt(1 + c + sqrt(c * c + 2 * c)) AS s FROM h3), h5 AS (SELECT *, f / (3 * g * g * (s + 1 + 1 / s) * (s + 1 + 1 / s)) AS p FROM h4), h6 AS (SELECT *, sqrt(1 + 2 * ee * ee * p) AS q FROM h5),
h7 AS (SELECT *, -p * ee * sqrt(rr) / (1 + q) + sqrt(0.5 * a * a * (1 + 1 / q) - p * (1 - ee) * z * z / (q * (1 + q)) - 0.5 * p * rr) AS r0 FROM h6),
h8 AS (SELECT *, sqrt((sqrt(rr) - ee * r0) * (sqrt(rr) - ee * r0) + z * z) AS u, sqrt((sqrt(rr) - ee * r0) * (sqrt(rr) - ee * r0) + (1 - ee) * z * z) AS v FROM h7),
back AS (SELECT {keys}, degrees(atan((z + (a * a / (b * b) - 1) * b * b * z / (a * v)) / sqrt(rr))) AS lat, degrees(atan2(y, x)) AS lon, u * (1 - b * b / (a * v)) AS hei FROM h8)"""


@query("WITH " + ECEF + HEIKKINEN.format(keys="id", source="ecef") + " SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(hei, 3) AS hei FROM back")
def ecef_to_llh_f2(spark, sf):
    lat, lon, hei = g.ecef_to_llh(F.col("x"), F.col("y"), F.col("z"))
    return ecef(spark, sf).select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(hei, 3).alias("hei"))


def turn_sql(axis: str, angle: str, source: str, out: str) -> str:
    c, s = f"cos(radians({angle}))", f"sin(radians({angle}))"
    xyz = {"x": ("vx", f"{c} * vy - {s} * vz", f"{s} * vy + {c} * vz"), "y": (f"{c} * vx + {s} * vz", "vy", f"{c} * vz - {s} * vx"), "z": (f"{c} * vx - {s} * vy", f"{s} * vx + {c} * vy", "vz")}[axis]
    return f", {out} AS (SELECT * REPLACE ({xyz[0]} AS vx, {xyz[1]} AS vy, {xyz[2]} AS vz) FROM {source})"


def look_sql(source: str) -> str:
    """CTEs from rows with vx, vy, vz and attitudes to look5 in the earth-centred frame."""
    return turn_sql("y", "pitch", source, "look1") + turn_sql("x", "roll", "look1", "look2") + turn_sql("z", "heading", "look2", "look3") + turn_sql("y", "-(90 + lat)", "look3", "look4") + turn_sql("z", "lon", "look4", "look5")


@query("WITH " + LLH + ", look0 AS (SELECT *, 0.2::DOUBLE AS vx, -0.3::DOUBLE AS vy, 1::DOUBLE AS vz FROM llh)" + look_sql("look0") + " SELECT id, round(vx, 8) AS x, round(vy, 8) AS y, round(vz, 8) AS z FROM look5")
def rotate_f4(spark, sf):
    v = g.look_to_ecef((F.lit(0.2), F.lit(-0.3), F.lit(1.0)), F.col("lat"), F.col("lon"), F.col("roll"), F.col("pitch"), F.col("heading"))
    return rounded(llh(spark, sf).select("id", *[c.alias(n) for n, c in zip("xyz", v, strict=True)]), 8)


@query("WITH " + ECEF + ", look0 AS (SELECT *, 0.5::DOUBLE AS vx, -1.25::DOUBLE AS vy, 2::DOUBLE AS vz FROM ecef)" + look_sql("look0") + ", moved AS (SELECT id, a, b, ee, x + vx AS x, y + vy AS y, z + vz AS z FROM look5)" + HEIKKINEN.format(keys="id", source="moved") + " SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(hei, 3) AS hei FROM back")
def lever_arm_f17(spark, sf):
    moved = nv.lever_arm(llh(spark, sf), 0.5, -1.25, 2.0)
    return moved.select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("hei", 3).alias("hei"))


@query("WITH " + LLH + " SELECT id, roll + 0.25 AS roll, pitch - 0.125 AS pitch, heading + 1.5 AS heading FROM llh")
def boresight_f16(spark, sf):
    return nv.boresight(llh(spark, sf), 0.25, -0.125, 1.5).select("id", "roll", "pitch", "heading")


def inverse_sql(keys: str, lon1: str, lat1: str, h1: str, lon2: str, lat2: str, h2: str, source: str) -> str:
    """CTEs up to `inverse` (keys, distance, azimuth, zenith): the published solution for short lines."""
    return f""", i0 AS (SELECT {keys}, radians({lat2}) AS phi, radians(({lat1}) - ({lat2})) AS north, radians(({lon1}) - ({lon2})) AS east, ({h2}) - ({h1}) AS rise, {g.EE2!r}::DOUBLE AS e2 FROM {source}),
i1 AS (SELECT *, sqrt(1 + e2 * pow(cos(phi), 4)) AS a, sqrt(1 + e2 * pow(cos(phi), 2)) AS b FROM i0), i2 AS (SELECT *, a * east / 2 AS w, north / (2 * b) * (1 + 3 * e2 / (4 * b * b) * north * sin(2 * phi + 2 * north / 3)) AS d FROM i1),
i3 AS (SELECT *, sin(d) * cos(w) AS e, sin(w) * (b * cos(phi) * cos(d) - sin(phi) * sin(d)) / a AS f, atan((sin(phi) + b * cos(phi) * tan(d)) * tan(w) / a) AS h FROM i2),
i4 AS (SELECT *, degrees(atan2(f, e) - h) AS az, {g.A!r}::DOUBLE * sqrt(1 + e2) * 2 * asin(sqrt(e * e + f * f)) / (b * b) AS s FROM i3),
inverse AS (SELECT {keys}, sqrt(s * s + rise * rise) AS distance, CASE WHEN az < 0 THEN az + 360 ELSE az END AS azimuth, CASE WHEN rise = 0 THEN 90 ELSE 180 - degrees(atan(s / rise)) END AS zenith FROM i4)"""


@query("WITH " + LLH + inverse_sql("id", "lon + 0.02", "lat + 0.01", "hei", "lon", "lat", "-50::DOUBLE", "llh") + " SELECT id, round(distance, 4) AS distance, round(azimuth, 5) AS azimuth, round(zenith, 5) AS zenith FROM inverse")
def geodesic_inverse_f5(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    d, az, ze = g.geodesic_inverse(lon + 0.02, lat + 0.01, F.col("hei"), lon, lat, F.lit(-50.0))
    return llh(spark, sf).select("id", F.round(d, 4).alias("distance"), F.round(az, 5).alias("azimuth"), F.round(ze, 5).alias("zenith"))


@query("WITH " + LLH + f""", d0 AS (SELECT id, lon, lat, radians(lat) AS phi, radians(heading) AS az, {g.EE2!r}::DOUBLE AS e2 FROM llh), d1 AS (SELECT *, sqrt(1 + e2 * pow(cos(phi), 4)) AS a, sqrt(1 + e2 * pow(cos(phi), 2)) AS b FROM d0),
d2 AS (SELECT *, 5000::DOUBLE * b * b / ({g.A!r}::DOUBLE * sqrt(1 + e2)) AS arc FROM d1), d3 AS (SELECT *, atan(a * tan(arc) * sin(az) / (b * cos(phi) - tan(arc) * sin(phi) * cos(az))) / a AS east FROM d2),
d4 AS (SELECT *, 0.5 * asin(sin(arc) * (cos(az) - sin(phi) * sin(az) * tan(0.5 * a * east) / a)) AS d FROM d3)
SELECT id, round(lon + degrees(east), 8) AS lon, round(lat + degrees(2 * d * (b - 1.5 * e2 * d * sin(2 * phi + 4 * b * d / 3))), 8) AS lat FROM d4""")  # fmt: skip
def geodesic_direct_f7(spark, sf):
    lon, lat = g.geodesic_direct(F.col("lon"), F.col("lat"), F.lit(5000.0), F.col("heading"))
    return llh(spark, sf).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("WITH " + ECEF + ", look0 AS (SELECT *, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 1::DOUBLE AS vz FROM ecef)" + look_sql("look0") + """, k AS (SELECT id, hei, (vx * vx + vy * vy) / ((a - 2000) * (a - 2000)) + vz * vz / ((b - 2000) * (b - 2000)) AS ka, 2 * (x * vx + y * vy) / ((a - 2000) * (a - 2000)) + 2 * z * vz / ((b - 2000) * (b - 2000)) AS kb,
  (x * x + y * y) / ((a - 2000) * (a - 2000)) + z * z / ((b - 2000) * (b - 2000)) - 1 AS kc FROM look5), r AS (SELECT *, sqrt(greatest(kb * kb - 4 * ka * kc, 0)) AS root FROM k), h AS (SELECT id, hei, (root - kb) / (2 * ka) AS n, (-kb - root) / (2 * ka) AS f FROM r),
d AS (SELECT id, CASE WHEN (n - hei) * (n - hei) < (f - hei) * (f - hei) THEN n ELSE f END AS d FROM h) SELECT id, round(CASE WHEN d >= 0 THEN d END, 3) AS distance FROM d""")  # fmt: skip
def ray_ellipsoid_f8(spark, sf):
    p = ecef(spark, sf)
    v = g.look_to_ecef((F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("lat"), F.col("lon"), F.col("roll"), F.col("pitch"), F.col("heading"))
    d = g.ray_ellipsoid((F.col("x"), F.col("y"), F.col("z")), v, F.col("hei"), -2000.0)
    return p.select("id", F.round(d, 3).alias("distance"))


@query("WITH " + i.DEM + f""", n AS (SELECT d.r, d.c, e.h, (e.r - d.r + 1) * 3 + e.c - d.c + 1 AS k FROM dem d JOIN dem e ON abs(e.r - d.r) <= 1 AND abs(e.c - d.c) <= 1), w AS (SELECT r, c, [max(h) FILTER (k = 0), max(h) FILTER (k = 1), max(h) FILTER (k = 2), max(h) FILTER (k = 3), max(h) FILTER (k = 4), max(h) FILTER (k = 5), max(h) FILTER (k = 6), max(h) FILTER (k = 7), max(h) FILTER (k = 8)] AS z FROM n GROUP BY r, c HAVING count(*) = 9),
m AS (SELECT r, c, z, radians(52 - r * 0.001::DOUBLE) AS phi FROM w), s AS (SELECT *, {math.pi / 180 * g.A!r}::DOUBLE * cos(atan({g.B / g.A!r}::DOUBLE * tan(phi))) AS xs, 111132.954::DOUBLE - 559.822::DOUBLE * cos(2 * phi) + 1.175::DOUBLE * cos(4 * phi) AS ys FROM m),
g AS (SELECT r, c, ((z[3] + 2 * z[6] + z[9]) - (z[1] + 2 * z[4] + z[7])) / (0.008::DOUBLE * xs) AS gx, ((z[1] + 2 * z[2] + z[3]) - (z[7] + 2 * z[8] + z[9])) / (0.008::DOUBLE * ys) AS gy FROM s),
a AS (SELECT r, c, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, 90 - degrees(atan2(-gy, -gx)) AS aspect FROM g) SELECT r, c, round(slope, 7) AS slope, round(CASE WHEN slope = 0 THEN 0 WHEN aspect < 0 THEN aspect + 360 ELSE aspect END, 6) AS aspect FROM a""")  # fmt: skip
def dem_slope_f11(spark, sf):
    out = geo.slope_aspect(i.dem(spark), 0.001, 0.001, 52.0)
    return out.select("r", "c", F.round("slope", 7).alias("slope"), F.round("aspect", 6).alias("aspect"))


# --- resampling ----------------------------------------------------------------------------------
GRID = rs.Grid(i.LEFT, i.TOP, i.SIZE, i.SIZE, i.ROWS, i.COLS)


@query("WITH " + i.POINTS + " SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points")
def array_limits_a11(spark, sf):
    return rs.array_limits(i.points(spark, sf), ("x", "y", "z"))


@query("WITH " + i.POINTS + """, s AS (SELECT line, max(x) FILTER (sample = 20) AS x0, max(y) FILTER (sample = 20) AS y0, max(x) FILTER (sample = 21) AS x1, max(y) FILTER (sample = 21) AS y1 FROM points WHERE sample IN (20, 21) GROUP BY line),
d AS (SELECT x0 - lag(x0) OVER (ORDER BY line) AS ax, y0 - lag(y0) OVER (ORDER BY line) AS ay, x1 - x0 AS bw, y1 - y0 AS bh FROM s), n AS (SELECT count(*) - 1 AS n FROM d)
SELECT 1 AS flight, round(sum(sqrt(ax * ax + ay * ay)) / any_value(n), 6) AS along, round(sum(CASE WHEN ax IS NOT NULL THEN sqrt(bw * bw + bh * bh) END) / any_value(n), 6) AS across, min(abs(ax)) AS min_x, round(sum(abs(ax)) / any_value(n), 6) AS mean_x, max(abs(ax)) AS max_x,
min(abs(ay)) AS min_y, round(sum(abs(ay)) / any_value(n), 6) AS mean_y, max(abs(ay)) AS max_y FROM d, n""")  # fmt: skip
def pixel_size_a12(spark, sf):
    return rounded(rs.pixel_sizes(i.points(spark, sf).withColumn("flight", F.lit(1)), 20))


@query("WITH " + i.GRID + " SELECT row, col, cx, cy FROM grid")
def grid_def_r6(spark, sf):
    return rs.grid_of(-999.9, 12.0, 9999.9, 9990.0, 500.0, 500.0).cells(spark)


NEAR = i.POINTS + ", " + i.GRID + ", near AS (SELECT row, col, cx, cy, line, sample, x, y, z, x - cx AS dx, y - cy AS dy, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM grid JOIN points ON abs(x - cx) <= 700 AND abs(y - cy) <= 700 AND (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 490000)"
LEVEL = NEAR + ", " + i.LEVEL1 + ", valued AS (SELECT near.*, band, value FROM near JOIN level1 USING (line, sample) WHERE value <> 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY row, col, band ORDER BY d2, line, sample) AS k FROM valued)"
QUAD = NEAR + ", q0 AS (SELECT *, CASE WHEN dy >= 0 THEN CASE WHEN dx < 0 THEN 0 ELSE 1 END ELSE CASE WHEN dx < 0 THEN 2 ELSE 3 END END AS quadrant FROM near), q1 AS (SELECT *, row_number() OVER (PARTITION BY row, col, quadrant ORDER BY d2, line, sample) AS k FROM q0), quad AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY row, col) AS n FROM q1 WHERE k <= {k}) WHERE n = 4 * {k})"


@query("WITH " + NEAR + ", r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, line, sample)::INTEGER AS rank FROM near) SELECT row, col, rank, line, sample, round(d2, 4) AS d2 FROM r WHERE rank <= 4")
def knn_j13(spark, sf):
    return rounded(rs.nearest(GRID.cells(spark), i.points(spark, sf), 4, i.RADIUS).select("row", "col", "rank", "line", "sample", "d2"), 4)


@query("WITH " + QUAD.format(k=1) + " SELECT row, col, quadrant, line, sample FROM quad")
def quad_knn_j14(spark, sf):
    return rs.nearest_by_quadrant(GRID.cells(spark), i.points(spark, sf), 1, i.RADIUS).select("row", "col", "quadrant", "line", "sample")


@query("WITH " + LEVEL + " SELECT row, col, band, k::INTEGER AS rank, line, sample FROM ranked WHERE k <= 3")
def knn_ignore_j15(spark, sf):
    return rs.nearest_values(GRID.cells(spark), i.points(spark, sf), i.level1(spark, sf), 3, i.RADIUS, 0.0).select("row", "col", "band", "rank", "line", "sample")


@query("WITH " + LEVEL + " SELECT row, col, band, value FROM ranked WHERE k = 1")
def map_nearest_r1(spark, sf):
    return rs.map_nearest(GRID.cells(spark), i.points(spark, sf), i.level1(spark, sf), i.RADIUS, 0.0).select("row", "col", "band", "value")


@query("WITH " + LEVEL + " SELECT row, col, band, line AS src_line, sample AS src_sample FROM ranked WHERE k = 1")
def rowcol_map_k12(spark, sf):
    return rs.map_nearest(GRID.cells(spark), i.points(spark, sf), i.level1(spark, sf), i.RADIUS, 0.0).drop("value")


@query("WITH " + LEVEL + " SELECT row, col, band, round(CASE WHEN min(d2) = 0 THEN max(value) FILTER (k = 1) ELSE sum(CASE WHEN d2 > 0 THEN value / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END) END, 6) AS value FROM ranked WHERE k <= 5 GROUP BY row, col, band")
def map_idw_r2(spark, sf):
    return rounded(rs.map_idw(GRID.cells(spark), i.points(spark, sf), i.level1(spark, sf), 5, i.RADIUS, 0.0))


def uv_sql(source: str) -> str:
    """CTEs from rows with x0..x3, y0..y3 (UL, UR, BL, BR), px and py to `inside`, those with u and v in the unit square."""
    ok = lambda c: f"({c} >= -1e-9 AND {c} <= 1 + 1e-9)"
    return f""", v0 AS (SELECT *, x1 - x0 AS ex, y1 - y0 AS ey, x2 - x0 AS fx, y2 - y0 AS fy, x0 - x1 - x2 + x3 AS gx, y0 - y1 - y2 + y3 AS gy, px - x0 AS hx, py - y0 AS hy FROM {source}),
v1 AS (SELECT *, gx * fy - gy * fx AS k2, ex * fy - ey * fx + hx * gy - hy * gx AS k1, hx * ey - hy * ex AS k0 FROM v0), v2 AS (SELECT *, sqrt(greatest(k1 * k1 - 4 * k0 * k2, 0)) AS root FROM v1), v3 AS (SELECT *, -0.5 * (k1 + CASE WHEN k1 < 0 THEN -root ELSE root END) AS q FROM v2),
v4 AS (SELECT *, CASE WHEN abs(k2) < 1e-12 * (abs(k1) + abs(k0) + 1e-300) THEN -k0 / k1 WHEN {ok("k0 / q")} THEN k0 / q WHEN {ok("q / k2")} THEN q / k2 END AS v FROM v3),
v5 AS (SELECT *, CASE WHEN abs(ex + gx * v) >= abs(ey + gy * v) THEN (hx - fx * v) / (ex + gx * v) ELSE (hy - fy * v) / (ey + gy * v) END AS u FROM v4), inside AS (SELECT * FROM v5 WHERE {ok("u")} AND {ok("v")})"""


CORNERS = ", ".join(f"max({c}) FILTER ({{key}} = {k}) AS {n}{k}" for k in range(4) for c, n in (("x", "x"), ("y", "y"), ("line", "l"), ("sample", "s")))
WEIGHTS = "[(1 - v) * (1 - u), (1 - v) * u, v * (1 - u), v * u]"


@query("WITH " + QUAD.format(k=1) + ", " + i.LEVEL1 + ", c AS (SELECT row, col, any_value(cx) AS px, any_value(cy) AS py, " + CORNERS.format(key="quadrant") + " FROM quad GROUP BY row, col)" + uv_sql("c") + f""",
w AS (SELECT row, col, unnest([l0, l1, l2, l3]) AS line, unnest([s0, s1, s2, s3]) AS sample, unnest({WEIGHTS}) AS w FROM inside) SELECT row, col, band, round(sum(w * value), 6) AS value FROM w JOIN level1 USING (line, sample) GROUP BY row, col, band HAVING count(*) = 4""")  # fmt: skip
def map_bilinear_r3(spark, sf):
    return rounded(rs.map_bilinear(GRID.cells(spark), i.points(spark, sf), i.level1(spark, sf), i.RADIUS))


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice + 0.5)::INTEGER AS rounded, trunc(l_extendedprice)::INTEGER AS truncated FROM lineitem")
def narrow_cast_k2(spark, sf):
    item = i.table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    return item.select("l_orderkey", "l_linenumber", "l_partkey", envi.narrow(price, 3).alias("rounded"), envi.narrow(price, 3, round_half=False).alias("truncated"))


@query("WITH " + LEVEL + ", b AS (SELECT row, col, b AS band FROM grid, range(3) t(b)) SELECT row, col, band, coalesce(value, -1)::INTEGER AS value FROM b LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (row, col, band)")
def map_pipeline(spark, sf):
    cells = GRID.cells(spark)
    mapped = rs.map_nearest(cells, i.points(spark, sf), i.level1(spark, sf), i.RADIUS, 0.0).select("row", "col", "band", "value")
    return rs.fill(cells, mapped, [0, 1, 2], -1.0, "int32")


SPLINE = i.SCANS + """, u0 AS (SELECT *, heading - lag(heading) OVER (PARTITION BY flight ORDER BY time) AS dh, first(heading) OVER (PARTITION BY flight ORDER BY time) AS h0 FROM nav),
u1 AS (SELECT *, CASE WHEN dh - 360 * floor((dh + 180) / 360) = -180 AND dh > 0 THEN 180 ELSE dh - 360 * floor((dh + 180) / 360) END AS turn FROM u0),
u2 AS (SELECT flight, time, lat, lon, hei, roll, pitch, h0 + coalesce(sum(turn) OVER (PARTITION BY flight ORDER BY time ROWS UNBOUNDED PRECEDING), 0) AS heading, row_number() OVER (PARTITION BY flight ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY flight) AS n FROM u1),
f AS (UNPIVOT u2 ON lat, lon, hei, roll, pitch, heading INTO NAME field VALUE y),
k AS (SELECT *, lead(time) OVER w - time AS h, (lead(y) OVER w - y) / (lead(time) OVER w - time) AS rise FROM f WINDOW w AS (PARTITION BY flight, field ORDER BY i)),
e AS (SELECT flight, field, i - 1 AS j, n, lag(h) OVER w AS h, h AS hn, 2 * (lag(h) OVER w + h) AS dg, 6 * (rise - lag(rise) OVER w) AS rt FROM k WINDOW w AS (PARTITION BY flight, field ORDER BY i) QUALIFY i > 0 AND i < n - 1),
fw AS (SELECT flight, field, j, n, hn, dg, rt FROM e WHERE j = 0 UNION ALL SELECT e.flight, e.field, e.j, e.n, e.hn, e.dg - e.h / fw.dg * e.h, e.rt - e.h / fw.dg * fw.rt FROM fw JOIN e ON e.flight = fw.flight AND e.field = fw.field AND e.j = fw.j + 1),
bw AS (SELECT flight, field, j, rt / dg AS z FROM fw WHERE j = n - 3 UNION ALL SELECT fw.flight, fw.field, fw.j, (fw.rt - fw.hn * bw.z) / fw.dg FROM bw JOIN fw ON fw.flight = bw.flight AND fw.field = bw.field AND fw.j = bw.j - 1),
sec AS (SELECT k.flight, k.field, k.i, k.n, k.time, k.y, k.h, coalesce(z, 0) AS z FROM k LEFT JOIN bw ON bw.flight = k.flight AND bw.field = k.field AND bw.j = k.i - 1),
seg AS (SELECT *, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(time) OVER w AS t1 FROM sec WINDOW w AS (PARTITION BY flight, field ORDER BY i)),
asked AS (SELECT s.flight, s.scan, s.time, greatest((SELECT count(*) FROM u2 WHERE u2.flight = s.flight AND u2.time < s.time) - 1, 0) AS i FROM scans s),
val AS (SELECT a.flight, a.time, a.scan, g.field, (g.t1 - a.time) / g.h AS a, (a.time - g.time) / g.h AS b, g.y, g.y1, g.z, g.z1, g.h FROM asked a JOIN seg g ON g.flight = a.flight AND g.i = a.i),
res AS (SELECT flight, time, field, a * y + b * y1 + ((a * a * a - a) * z + (b * b * b - b) * z1) * h * h / 6 AS v FROM val), fin AS (SELECT flight, time, field, coalesce(CASE WHEN field = 'heading' THEN v - 360 * floor(v / 360) ELSE v END, 'NaN'::DOUBLE) AS v FROM res)"""


@query("WITH RECURSIVE " + SPLINE + " SELECT flight, round(time, 6) AS time, " + ", ".join(f"round(max(v) FILTER (field = '{c}'), 4) AS {c}" for c in nv.FIELDS) + " FROM fin GROUP BY flight, time")
def spline_w8(spark, sf):
    out = nv.spline(i.scans(spark, sf), i.nav(spark, sf))
    return out.select("flight", F.round("time", 6).alias("time"), *[F.round(c, 4).alias(c) for c in nv.FIELDS])


def hermite_sql(keys: str, x: str, at: str, values: dict[str, str], source: str, out: str) -> str:
    """CTEs from four rows for each of keys to `out`: the cubic Hermite of each of values over x, at a place."""
    lists = ", ".join(f"list({f} ORDER BY {x}, {f}) AS l_{n}" for n, f in values.items())

    def value(f: str) -> str:
        m0, m1 = f"CASE WHEN i = 1 THEN 0 ELSE ({f}[i + 1] - {f}[i - 1]) / (xs[i + 1] - xs[i - 1]) END", f"CASE WHEN i = 3 THEN 0 ELSE ({f}[i + 2] - {f}[i]) / (xs[i + 2] - xs[i]) END"
        return f"(2 * t * t * t - 3 * t * t + 1) * {f}[i] + (t * t * t - 2 * t * t + t) * w * ({m0}) + (3 * t * t - 2 * t * t * t) * {f}[i + 1] + (t * t * t - t * t) * w * ({m1})"

    return f""", {out}0 AS (SELECT {keys}, any_value({at}) AS p, list({x} ORDER BY {x}) AS xs, {lists} FROM {source} GROUP BY {keys}), {out}1 AS (SELECT *, greatest(least(len(list_filter(xs, lambda c: c <= p)), 3), 1) AS i FROM {out}0),
{out}2 AS (SELECT *, xs[i + 1] - xs[i] AS w, greatest(least((p - xs[i]) / (xs[i + 1] - xs[i]), 1), 0) AS t FROM {out}1), {out} AS (SELECT {keys}, {", ".join(f"{value(f'l_{n}')} AS {n}" for n in values)} FROM {out}2)"""


FAR_QUAD = QUAD.format(k=4).replace("<= 700", "<= 1500").replace("490000", "2250000")


@query("WITH " + FAR_QUAD + ", " + i.LEVEL1 + """, pv AS (SELECT row, col, band, cx, cy, quadrant, x, y, value, row_number() OVER (PARTITION BY row, col, band, quadrant ORDER BY -y, x, value) AS pos FROM quad JOIN level1 USING (line, sample)),
rw AS (SELECT *, quadrant // 2 * 2 + (pos - 1) // 2 AS part FROM pv QUALIFY count(*) OVER (PARTITION BY row, col, band) = 16)""" + hermite_sql("row, col, band, part, cy", "x", "cx", {"val": "value", "hgt": "y"}, "rw", "ha") + hermite_sql("row, col, band", "hgt", "cy", {"value": "val"}, "ha", "hb") + " SELECT row, col, band, round(value, 6) AS value FROM hb")  # fmt: skip
def cubic_r5(spark, sf):
    return rounded(rs.map_cubic(GRID.cells(spark), i.points(spark, sf), i.level1(spark, sf), 1500.0))


@query("WITH " + NEAR + ", " + i.LEVEL1 + """, n10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, line, sample) AS rank FROM near) WHERE rank <= 10),
qd AS (SELECT row, col, cx, cy, rank * 4 + i AS ord, line - i // 2 AS ql, sample - i % 2 AS qs FROM n10, range(4) t(i)), cr AS (SELECT qd.*, k, p.x, p.y, p.line, p.sample FROM qd, range(4) t(k), points p WHERE p.line = ql + k // 2 AND p.sample = qs + k % 2),
c AS (SELECT row, col, ord, any_value(cx) AS px, any_value(cy) AS py, """ + CORNERS.format(key="k") + " FROM cr GROUP BY row, col, ord HAVING count(*) = 4)" + uv_sql("c") + f""", best AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY ord) = 1),
w AS (SELECT row, col, unnest([l0, l1, l2, l3]) AS line, unnest([s0, s1, s2, s3]) AS sample, unnest({WEIGHTS}) AS w FROM best UNION ALL SELECT row, col, line, sample, 1 FROM n10 WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.row = n10.row AND b.col = n10.col))
SELECT row, col, band, round(sum(w * value), 6) AS value FROM w JOIN level1 USING (line, sample) GROUP BY row, col, band""")  # fmt: skip
def bilinear_lev1_r4(spark, sf):
    return rounded(rs.map_quads(GRID.cells(spark), i.points(spark, sf), i.level1(spark, sf), i.RADIUS))


def utm_sql() -> str:
    n = g.FLATTENING / (2 - g.FLATTENING)
    e, radius = 2 * math.sqrt(n) / (1 + n), g.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    east, north = (" + ".join(f"{k!r}::DOUBLE * {a}({2 * j} * xi) * {b}({2 * j} * eta)" for j, k in enumerate(series, 1)) for a, b in (("cos", "sinh"), ("sin", "cosh")))
    return f""", z AS (SELECT id, radians(lat) AS phi, radians(lon - (least(floor((lon + 180) / 6) + 1, 60) * 6 - 183)) AS lam FROM llh), t AS (SELECT *, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t FROM z),
x AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT id, round(500000 + {0.9996 * radius!r}::DOUBLE * (eta + {east}), 3) AS easting, round({0.9996 * radius!r}::DOUBLE * (xi + {north}), 3) AS northing FROM x"""


@query("WITH " + LLH + utm_sql())
def utm_f18(spark, sf):
    x, y = g.utm(F.col("lat"), F.col("lon"))
    return llh(spark, sf).select("id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


@query("""WITH RECURSIVE s AS (SELECT user_id AS flight, event_id AS seq, floor(epoch_us(ts) / 1000000)::BIGINT + 1 AS gps, 1 - value % 1 AS delay, event_id * 30 % 10000 - 1 AS frame, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT flight, seq, gps, delay, frame, 0::BIGINT AS wraps, i FROM s WHERE i = 1 UNION ALL
 SELECT s.flight, s.seq, CASE WHEN s.gps = r.gps THEN s.gps + 1 WHEN s.gps = r.gps + 2 THEN s.gps - 1 ELSE s.gps END, s.delay, s.frame + CASE WHEN s.frame + r.wraps < r.frame THEN r.wraps + 10000 ELSE r.wraps END, CASE WHEN s.frame + r.wraps < r.frame THEN r.wraps + 10000 ELSE r.wraps END, s.i FROM r JOIN s ON s.flight = r.flight AND s.i = r.i + 1)
SELECT flight, seq, gps, round(delay, 6) AS delay, frame FROM r""")
def persec_repair_w12(spark, sf):
    e = i.table(spark, sf, "events")
    syncs = e.select(F.col("user_id").alias("flight"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("gps"), (F.col("value") % 1).alias("delay"), (F.col("event_id") * 30 % 10000).alias("frame"))
    return rounded(nv.normalise_syncs(syncs))


def place_sql(lat: str, lon: str, hei: str) -> str:
    """x, y and z of a position."""
    c = f"sqrt(1 - {g.EE!r}::DOUBLE * sin(radians({lat})) * sin(radians({lat})))"
    n = f"({g.A!r}::DOUBLE / {c} + {hei})"
    return f"{n} * cos(radians({lat})) * cos(radians({lon})) AS x, {n} * cos(radians({lat})) * sin(radians({lon})) AS y, ({g.A * (1 - g.EE)!r}::DOUBLE / {c} + {hei}) * sin(radians({lat})) AS z"


def cross_sql(a: str, b: str) -> list[str]:
    return [f"({a}{p} * {b}{q} - {a}{q} * {b}{p})" for p, q in (("y", "z"), ("z", "x"), ("x", "y"))]


def dot_sql(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def axes(name: str) -> list[str]:
    return [f"{name}{c}" for c in "xyz"]


RAY_DEM = (
    i.DEM + """, sc AS (SELECT s_suppkey AS scan, 51.975 - s_suppkey % 20 * 0.0003::DOUBLE AS lat, 0.02 + s_suppkey % 15 * 0.0004::DOUBLE AS lon, 1200::DOUBLE AS hei, (s_nationkey % 5 - 2)::DOUBLE AS roll, 1::DOUBLE AS pitch, (s_suppkey % 360)::DOUBLE AS heading FROM supplier),
look0 AS (SELECT sc.*, k::INTEGER AS sample, (k - 4) * 2::DOUBLE AS ry, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 1::DOUBLE AS vz FROM sc, range(9) t(k))""" + turn_sql("y", "ry", "look0", "look00") + look_sql("look00")
    + ", ray AS (SELECT scan, sample, vx AS dx, vy AS dy, vz AS dz, " + place_sql("lat", "lon", "hei") + " FROM look5), vt AS (SELECT r, c, " + place_sql("(52 - r * 0.001::DOUBLE)", "(c * 0.001::DOUBLE)", "h") + """ FROM dem),
tr AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, e.x - a.x AS wx, e.y - a.y AS wy, e.z - a.z AS wz FROM vt a JOIN vt b ON b.r = a.r AND b.c = a.c + 1 JOIN vt e ON e.r = a.r + 1 AND e.c = a.c + 1
 UNION ALL SELECT a.x, a.y, a.z, e.x - a.x, e.y - a.y, e.z - a.z, b.x - a.x, b.y - a.y, b.z - a.z FROM vt a JOIN vt b ON b.r = a.r + 1 AND b.c = a.c JOIN vt e ON e.r = a.r + 1 AND e.c = a.c + 1),
m0 AS (SELECT scan, sample, x - ax AS sx, y - ay AS sy, z - az AS sz, dx, dy, dz, ux, uy, uz, wx, wy, wz FROM ray, tr),
m1 AS (SELECT *, """ + ", ".join(f"{e} AS p{c}" for c, e in zip("xyz", cross_sql("d", "w"), strict=True)) + ", " + ", ".join(f"{e} AS q{c}" for c, e in zip("xyz", cross_sql("s", "u"), strict=True)) + " FROM m0), m2 AS (SELECT *, "
    + dot_sql(axes("u"), axes("p")) + " AS det FROM m1), m3 AS (SELECT scan, sample, " + dot_sql(axes("s"), axes("p")) + " / det AS bu, " + dot_sql(axes("q"), axes("d")) + " / det AS bv, " + dot_sql(axes("w"), axes("q")) + """ / det AS t FROM m2),
hit AS (SELECT scan, sample, min(t) AS distance FROM m3 WHERE bu >= -1e-8 AND bv >= -1e-8 AND bu + bv <= 1 + 1e-8 AND t >= 0 GROUP BY scan, sample),
land AS (SELECT scan, sample, distance, """ + CONSTANTS + ", x + distance * dx AS x, y + distance * dy AS y, z + distance * dz AS z FROM ray LEFT JOIN hit USING (scan, sample))" + HEIKKINEN.format(keys="scan, sample, distance", source="land")
)


@query("WITH " + RAY_DEM + " SELECT scan, sample, round(lon, 7) AS lon, round(lat, 7) AS lat, round(hei, 3) AS height, round(distance, 3) AS distance FROM back")
def ray_dem_j18(spark, sf):
    k = F.col("s_suppkey")
    scans = i.table(spark, sf, "supplier").select(k.alias("scan"), (51.975 - k % 20 * 0.0003).alias("lat"), (0.02 + k % 15 * 0.0004).alias("lon"), F.lit(1200.0).alias("hei"), (F.col("s_nationkey") % 5 - 2).cast("double").alias("roll"), F.lit(1.0).alias("pitch"), (k % 360).cast("double").alias("heading"))
    views = spark.range(9).select(F.col("id").cast("int").alias("sample"), F.lit(0.0).alias("rx"), ((F.col("id") - 4) * 2.0).alias("ry"), F.lit(0.0).alias("rz"))
    out = geo.locate_on_dem(scans, views, i.dem(spark), 0.0, 52.0, 0.001, 0.001)
    return out.select("scan", "sample", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round("height", 3).alias("height"), F.round("distance", 3).alias("distance"))


# --- further operators ---------------------------------------------------------------------------
@query("""WITH d AS (SELECT l_linenumber AS band, l_suppkey % 16 AS sample, l_extendedprice * CASE WHEN l_orderkey % 97 = 0 THEN 10 ELSE 1 END AS value FROM lineitem), s AS (SELECT *, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS sd, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY band, sample))
SELECT band, sample, round(avg(value), 4) AS mean, count(*) AS kept, count(*) < any_value(n) / 2 AS few FROM s WHERE abs(value - m) <= 3 * sd GROUP BY band, sample""")
def dark_refined_default_a3(spark, sf):
    item = i.table(spark, sf, "lineitem")
    value = F.col("l_extendedprice") * F.when(F.col("l_orderkey") % 97 == 0, 10).otherwise(1)
    return rounded(cal.dark_refined(item.select(F.col("l_linenumber").alias("band"), (F.col("l_suppkey") % 16).alias("sample"), value.alias("value"))), 4)


@query("WITH " + DELTAS + " SELECT flight, (count(*) + coalesce(sum(CASE WHEN delta > 1 THEN delta - 1 END), 0))::BIGINT AS lines, 300::BIGINT AS samples FROM d GROUP BY flight")
def output_dimensions_p17(spark, sf):
    return cal.output_dimensions(lines(spark, sf), 20, 319)


@query("WITH " + FLAGGED + """ SELECT line, sample, band, CASE WHEN f.mask & 11 <> 0 OR (f.mask & 4 <> 0 AND (band + sample) % 3 = 0) THEN 0 ELSE c.value END AS value FROM cells c JOIN flagged f USING (line, sample, band)""")
def mask_join_j1(spark, sf):
    cells, mask = i.cells(spark, sf).drop("label"), flagged(spark, sf).select("line", "sample", "band", "mask")
    method = cells.select("line", "sample", "band", F.when((F.col("band") + F.col("sample")) % 3 == 0, 1).otherwise(8).alias("method"))
    return cal.mask_level1(cells, mask, method, flags=15, methods=1).select("line", "sample", "band", "value")


MATCHED = """raw AS (SELECT p_partkey AS band, p_retailprice AS wavelength FROM part), c AS (SELECT p_partkey AS cal_band, p_retailprice + (p_partkey % 3) * 0.004::DOUBLE AS w FROM part), matched AS (SELECT band, min(cal_band) AS cal_band FROM raw JOIN c ON abs(wavelength - w) <= 0.006::DOUBLE GROUP BY band)"""


@query("WITH " + MATCHED + " SELECT m.band, p_size AS sample, p_retailprice AS gain FROM matched m JOIN part ON p_partkey = m.cal_band")
def trim_gains_c5(spark, sf):
    gains = i.table(spark, sf, "part").select(F.col("p_partkey").alias("band"), F.col("p_size").alias("sample"), F.col("p_retailprice").alias("gain"))
    return cal.trim_gains(gains, wavelength_match_j6(spark, sf))


@query("WITH " + MATCHED + " SELECT m.band, p_size AS sample FROM matched m JOIN part ON p_partkey = m.cal_band")
def remap_bad_j7(spark, sf):
    bad = i.table(spark, sf, "part").select(F.col("p_partkey").alias("band"), F.col("p_size").alias("sample"))
    return cal.remap_bad_pixels(bad, wavelength_match_j6(spark, sf)).select("band", "sample")


@query("SELECT (c_custkey // 4 - 2)::INTEGER AS sample, round(avg(c_acctbal), 6) AS rx, round(avg(c_nationkey), 6) AS ry, round(avg(c_custkey % 7), 6) AS rz FROM customer GROUP BY c_custkey // 4 HAVING c_custkey // 4 BETWEEN 2 AND 101")
def view_binning_a9(spark, sf):
    c = i.table(spark, sf, "customer")
    return rounded(geo.bin_views(c.select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("rx"), F.col("c_nationkey").alias("ry"), (F.col("c_custkey") % 7).alias("rz")), 4, 2, 100))


RAYS = ECEF + ", look0 AS (SELECT ecef.* , k AS sample, (k - 4) * 19.7::DOUBLE AS ry, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 1::DOUBLE AS vz FROM ecef, range(9) t(k))" + turn_sql("y", "ry", "look0", "look00") + look_sql("look00") + ", ray AS (SELECT id, sample, vx, vy, vz, -(x * vx + y * vy + z * vz) AS down, degrees(acos(greatest(-1, least(1, -(x * vx + y * vy + z * vz) / sqrt(x * x + y * y + z * z))))) > 80 AS bad FROM look5)"


def wide_rays(spark, sf):
    views = spark.range(9).select(F.col("id").alias("sample"), F.lit(0.0).alias("rx"), ((F.col("id") - 4) * 19.7).alias("ry"), F.lit(0.0).alias("rz"))
    return geo.rays(llh(spark, sf).withColumnRenamed("id", "scan"), views)


@query("WITH " + RAYS + " SELECT id AS scan, sample, round(CASE WHEN NOT bad THEN vx END, 8) AS dx, round(CASE WHEN NOT bad THEN vy END, 8) AS dy, round(CASE WHEN NOT bad THEN vz END, 8) AS dz FROM ray")
def view_rays_j12(spark, sf):
    return wide_rays(spark, sf).select("scan", "sample", *[F.round(c, 8).alias(c) for c in ("dx", "dy", "dz")])


@query("WITH " + RAYS + " SELECT count(*) FILTER (bad) AS bad FROM ray")
def bad_views_a19(spark, sf):
    return geo.bad_view_angles(wide_rays(spark, sf))


@query("WITH " + RAYS + " SELECT id AS scan, max_by(sample, down) AS nadir FROM ray WHERE NOT bad GROUP BY id")
def nadir_f15(spark, sf):
    return geo.nadir(wide_rays(spark, sf))


@query("WITH " + LLH + inverse_sql("id", "lon", "lat", "hei", "lon - 0.01", "lat + 0.02", "100::DOUBLE", "llh") + " SELECT id, round(azimuth, 5) AS azimuth, round(zenith, 5) AS zenith, round(distance, 4) AS path FROM inverse")
def atmosphere_k11(spark, sf):
    located = llh(spark, sf).withColumns({"pixel_lon": F.col("lon") - 0.01, "pixel_lat": F.col("lat") + 0.02, "pixel_hei": F.lit(100.0)})
    return geo.atmosphere(located).select("id", F.round("azimuth", 5).alias("azimuth"), F.round("zenith", 5).alias("zenith"), F.round("path", 4).alias("path"))


@query("WITH " + i.DEM + ", p AS (SELECT c_custkey AS id, c_nationkey % 61 AS r, c_custkey % 61 AS c FROM customer) SELECT id, h FROM p LEFT JOIN dem USING (r, c)")
def dem_height_s24(spark, sf):
    p = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 61 * 0.001 + 0.0004).alias("lon"), (52 - F.col("c_nationkey") % 61 * 0.001 - 0.0004).alias("lat"))
    return geo.height_at(p, i.dem(spark), 0.0, 52.0, 0.001, 0.001).select("id", "h")


@query("WITH " + i.SCANS + ", later AS (SELECT flight, scan, time + 1800 AS time FROM scans)" + LINEAR.format(scans="later") + " SELECT flight, scan, round(heading, 5) AS heading FROM linear")
def attitude_offset_w9(spark, sf):
    scans = i.scans(spark, sf)
    out = nv.attitude_offset(scans, i.nav(spark, sf), nv.interpolate(scans, i.nav(spark, sf)), 1800.0)
    return out.select("flight", "scan", F.round("heading", 5).alias("heading"))


DEGREES = "deg AS (SELECT line, sample, x / 1000 AS lon, y / 1000 + 40 AS lat FROM points)"


@query("WITH " + i.POINTS + ", " + DEGREES + """, s AS (SELECT line, max(lon) FILTER (sample = 20) AS x0, max(lat) FILTER (sample = 20) AS y0, max(lon) FILTER (sample = 21) AS x1, max(lat) FILTER (sample = 21) AS y1 FROM deg WHERE sample IN (20, 21) GROUP BY line),
st AS (SELECT line, x0, y0, x1, y1, lag(x0) OVER (ORDER BY line) AS px, lag(y0) OVER (ORDER BY line) AS py FROM s), two AS (SELECT line, 0 AS kind, x0 AS ax, y0 AS ay, px AS qx, py AS qy FROM st WHERE px IS NOT NULL UNION ALL SELECT line, 1, x1, y1, x0, y0 FROM st WHERE px IS NOT NULL)""" + inverse_sql("line, kind", "ax", "ay", "0::DOUBLE", "qx", "qy", "0::DOUBLE", "two") + """
SELECT 1 AS flight, round(sum(distance) FILTER (kind = 0) / (SELECT count(*) - 1 FROM s), 3) AS along, round(sum(distance) FILTER (kind = 1) / (SELECT count(*) - 1 FROM s), 3) AS across FROM inverse""")  # fmt: skip
def mean_separation_a13(spark, sf):
    p = i.points(spark, sf).withColumns({"x": F.col("x") / 1000, "y": F.col("y") / 1000 + 40, "flight": F.lit(1)})
    return rounded(rs.mean_separation(p, 20), 3)


def globe_sql(lon: str, lat: str, left: float, top: float, dx: float, dy: float, radius: float) -> str:
    chord = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)"
    return f"""WITH {i.POINTS}, pe AS (SELECT line, sample, {place_sql(f"({lat})", f"({lon})", "0::DOUBLE").replace("points.", "")} FROM (SELECT line, sample, x AS px, y AS py FROM points)), ce AS (SELECT r AS row, k AS col, {place_sql(f"({top} - (r + 0.5::DOUBLE) * {dy})", f"({left} + (k + 0.5::DOUBLE) * {dx})", "0::DOUBLE")} FROM range(20) a(r), range(22) b(k)),
n AS (SELECT row, col, line, sample, {chord} AS d2 FROM ce c JOIN pe p ON {chord} <= {radius * radius!r}::DOUBLE), k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, line, sample)::INTEGER AS rank FROM n)
SELECT row, col, rank, line, sample, round(sqrt(d2), 2) AS distance FROM k WHERE rank <= 3"""


def globe_nearest(spark, sf, lon, lat, left, top, dx, dy, radius):
    points = i.points(spark, sf).withColumns({"px": F.col("x"), "py": F.col("y")}).withColumns({"x": F.expr(lon), "y": F.expr(lat)})
    near = rs.nearest(rs.Grid(left, top, dx, dy, 20, 22).cells(spark), points, 3, radius, geodesic=True)
    return near.select("row", "col", "rank", "line", "sample", F.round(F.sqrt("d2"), 2).alias("distance"))


DATE_LINE = ("px / 1250 + 176", "py / 1250 + 60", 176.0, 68.0, 0.4, 0.4, 60_000.0)
POLE = ("px / 30", "90 - py / 20000", -180.0, 90.0, 16.0, 0.02, 20_000.0)


@query(globe_sql(*DATE_LINE))
def knn_geodesic_j16(spark, sf):
    # Beyond the date line longitudes start anew; the grid's go on.
    lon = "CASE WHEN px / 1250 + 176 > 180 THEN px / 1250 + 176 - 360 ELSE px / 1250 + 176 END"
    return globe_nearest(spark, sf, lon, *DATE_LINE[1:])


@query(globe_sql(*POLE))
def knn_pole_j17(spark, sf):
    return globe_nearest(spark, sf, *POLE)
