"""Products on ENVI cubes: gains, view vectors, navigation, input geometry, maps; sensor headers.

Cubes of few bands are pivoted to one row per line and sample. Sentinels become nulls on reading and
come back on writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import envi

NAV_BANDS = ["time", "lat", "lon", "hei", "roll", "pitch", "heading"]
IGM_BANDS = ["x", "y", "z"]
VIEW_BANDS = ["rx", "ry", "rz"]
ATMOSPHERE_BANDS = ["azimuth", "zenith", "distance", "slope", "aspect"]


def pivoted(spark: SparkSession, path: str, bands: list[str], ignore: float | None = None) -> DataFrame:
    """A cube of named bands as (line, sample, bands); the ignored value becomes null."""
    layout = envi.Layout(path)
    if layout.bands != len(bands):
        raise ValueError(f"{path} has {layout.bands} bands; {len(bands)} are needed")
    c = envi.cells(envi.read_cube(spark, path))
    value = F.col("value") if ignore is None else F.when(F.col("value") != ignore, F.col("value"))
    return c.groupBy("line", "sample").agg(*[F.max(F.when(F.col("band") == i, value)).alias(n) for i, n in enumerate(bands)])


def unpivoted(df: DataFrame, bands: list[str], ignore: float | None = None) -> DataFrame:
    """Rows (line, sample, bands) as band lines."""
    value = lambda n: F.col(n).cast("double") if ignore is None else F.coalesce(F.col(n).cast("double"), F.lit(ignore))
    c = df.select("line", "sample", F.posexplode(F.array(*[value(n) for n in bands])).alias("band", "value"))
    return envi.band_lines(c)


def read_nav(spark: SparkSession, path: str) -> DataFrame:
    """One sample, seven bands: (scan, time, lat, lon, hei, roll, pitch, heading)."""
    if envi.Layout(path).samples != 1:
        raise ValueError("a navigation cube has one sample")
    return pivoted(spark, path, NAV_BANDS).drop("sample").withColumnRenamed("line", "scan")


def write_nav(nav: DataFrame, path: str, scans: int) -> None:
    """K8: heights cut to centimetres, times to seconds of the day."""
    out = nav.withColumns({"hei": F.floor(F.col("hei") * 100) / 100, "time": F.pmod("time", F.lit(86400.0)), "sample": F.lit(0)}).withColumnRenamed("scan", "line")
    envi.write_bil(unpivoted(out, NAV_BANDS), path, 5, scans, 1, len(NAV_BANDS), {"band names": NAV_BANDS})


def write_quality(nav: DataFrame, path: str, scans: int) -> None:
    """K9: one byte of quality bits for each scan."""
    out = nav.select(F.col("scan").alias("line"), F.lit(0).alias("sample"), "quality")
    envi.write_bil(unpivoted(out, ["quality"]), path, 1, scans, 1, 1)


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """(sample, rx, ry, rz) of the first line."""
    return pivoted(spark, path, VIEW_BANDS).filter("line = 0").drop("line")


def read_igm(spark: SparkSession, path: str) -> DataFrame:
    """(line, sample, x, y, z) of float64; the header's ignore value becomes null."""
    header = envi.read_header(path)
    if header["data type"][0] != "5":
        raise ValueError("input geometry must be float64")
    ignore = header.get("data ignore value")
    return pivoted(spark, path, IGM_BANDS, float(ignore[0]) if ignore else None)


def write_igm(igm: DataFrame, path: str, lines: int, samples: int, ignore: float = -9999.0) -> None:
    """With the limits of x and y in the header."""
    low = igm.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    limits = dict(zip((";min x", ";max x", ";min y", ";max y"), low, strict=True))
    envi.write_bil(unpivoted(igm, IGM_BANDS, ignore), path, 5, lines, samples, 3, {"band names": IGM_BANDS, "data ignore value": ignore} | limits)


def write_atmosphere(rows: DataFrame, path: str, lines: int, samples: int, ignore: float = -9999.0) -> None:
    """K11."""
    envi.write_bil(unpivoted(rows, ATMOSPHERE_BANDS, ignore), path, 5, lines, samples, 5, {"band names": ATMOSPHERE_BANDS, "data ignore value": ignore})


def read_gains(spark: SparkSession, path: str, sensor_id: int) -> DataFrame:
    """(band, sample, gain) of a one-line float32 cube for the same sensor."""
    header = envi.read_header(path)
    if header["lines"][0] != "1" or header["data type"][0] != "4":
        raise ValueError("a gain file has one line of float32")
    if int(header["sensorid"][0]) != sensor_id:
        raise ValueError("the gain file is for another sensor")
    if len(header["wavelength"]) != int(header["bands"][0]):
        raise ValueError("the gain file must have a wavelength for each band")
    return envi.cells(envi.read_cube(spark, path)).select("band", "sample", F.col("value").alias("gain"))


def sensor_items(header: dict[str, list[str]], part: int | None = None) -> dict[str, object]:
    """Binning, image limits (0-based), integration time and wavelengths, by one name for all sensors.

    part: 1 or 2 for the two detectors of one file, whose keys end in that number (the first's binning has none).
    """
    end = "" if part is None else str(part)
    pair = lambda key: [int(float(x)) for x in header[key]]
    binning = pair("binning" if part in (None, 1) else f"binning{part}")
    himg, vimg = ([x - 1 for x in pair(f"{k}{end}")] for k in ("himg", "vimg"))
    waves, widths = ([float(x) for x in header.get(k, [])] for k in ("wavelength", "fwhm"))
    if part is not None:
        waves, widths = waves[vimg[0] : vimg[1] + 1], widths[vimg[0] : vimg[1] + 1]
    return {"spectral_binning": binning[0], "spatial_binning": binning[1], "samples": himg, "bands": vimg, "integration_time": float(header[f"tint{end}"][0]), "wavelength": waves, "fwhm": widths}


def sub_sensor(bands: DataFrame, items: dict[str, object]) -> DataFrame:
    """A detector's bands of a joint cube, numbered from 0."""
    low, high = items["bands"]
    return bands.filter(F.col("band").between(low, high)).withColumn("band", F.col("band") - low)


def join_sensors(first: DataFrame, second: DataFrame, first_bands: int) -> DataFrame:
    """The lines of two detectors as one product."""
    return first.unionByName(second.withColumn("band", F.col("band") + first_bands))


def split_dark(bands: DataFrame, header: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Image lines and dark lines (from autodarkstartline on)."""
    start = int(header["autodarkstartline"][0])
    return bands.filter(F.col("line") < start), bands.filter(F.col("line") >= start)


def write_map(mapped: DataFrame, path: str, rows: int, cols: int, bands: int, code: int, info: list[str], nodata: float = 0.0, wavelengths: list[float] | None = None, names: list[str] | None = None, units: str | None = None) -> None:
    """A filled map (row, col, band, value), truncated to the type, with its place in the header."""
    c = mapped.select(F.col("row").alias("line"), "band", F.col("col").alias("sample"), F.col("value").cast("double").alias("value"))
    header = {"map info": info, "data ignore value": nodata} | {k: v for k, v in (("wavelength", wavelengths), ("band names", names), ("Radiance data units", units)) if v}
    envi.write_bil(envi.band_lines(c), path, code, rows, cols, bands, header, round_half=False)


def write_detector(table: DataFrame, path: str, column: str, bands: int, samples: int) -> None:
    """Dumps of dark means or gains (band, sample, column) as a cube of one line."""
    c = table.select(F.lit(0).alias("line"), "band", "sample", F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("value"))
    envi.write_bil(envi.band_lines(c), path, 4, 1, samples, bands)


def write_level1(cells: DataFrame, prefix: str, lines: int, samples: int, bands: int, header: dict | None = None, fodis: DataFrame | None = None) -> list[str]:
    """K6: the level-1 product set of cells (line, band, sample, value, mask and perhaps method): image, mask, method, and the FODIS spectrum (line, band, fodis). Returns the paths."""
    paths = []

    def put(table: DataFrame, column: str, end: str, code: int, wide: int, more: dict | None = None) -> None:
        paths.append(f"{prefix}{end}")
        c = table.select("line", "band", "sample", F.col(column).cast("double").alias("value"))
        envi.write_bil(envi.band_lines(c), paths[-1], code, lines, wide, bands, more)

    put(cells, "value", ".bil", 12, samples, header)
    put(cells, "mask", "_mask.bil", 1, samples)
    if "method" in cells.columns:
        put(cells, "method", "_mask-badpixelmethod.bil", 1, samples)
    if fodis is not None:
        put(fodis.withColumn("sample", F.lit(0)), "fodis", "_FODIS.bil", 12, 1, header)
    return paths


def frame_counters(cells: DataFrame) -> DataFrame:
    """Line and frame, the 16-bit counter in the cell (0, 0) of a raw line; a sub-sensor's lines keep the joint cube's."""
    return cells.filter("band = 0 AND sample = 0").select("line", F.col("value").cast("long").alias("frame"))


def load_bad_pixels(spark: SparkSession, sensor_id: int, prefix: str | None, bands: DataFrame | None = None) -> DataFrame | None:
    """The bad pixels beside a calibration file, none for Eagle or without a prefix; bands (band, cal_band) turn them into raw bands."""
    from ..operators.calibration import remap_bad_pixels, sensor_of
    from .nav import read_bad_pixels

    if sensor_of(sensor_id).eagle or not prefix:
        return None
    bad = read_bad_pixels(spark, f"{prefix}.bad")
    return bad if bands is None else remap_bad_pixels(bad, bands)
