"""Radiometric calibration on cells (line, sample, band, value): dark frames, flags, smear, gains.

All of it is narrow or aggregates by (band, sample); dark, gain and bad-pixel tables have a row per
detector element, so Spark broadcasts them by their size, and shuffles them if they are large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of the mask, and of the method of bad pixels.
UNDERFLOW, OVERFLOW, BADPIXEL, SMEAR, DROPPED, CORRUPT, QC = 1, 2, 4, 8, 16, 32, 64
METHODS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16, "F": 32}
MAX_VALUE, SMEAR_SECONDS, GAIN_SCALE, WAVELENGTH_TOLERANCE, COUNTER_WRAP = 65535, 0.002, 1000.0, 0.006, 65536
PIXEL = ["band", "sample"]


@dataclass(frozen=True)
class Sensor:
    """A sensor's family, its largest raw value and what it is flipped by."""

    family: str
    raw_max: int
    eagle: bool = False
    flip: str = ""


#: Sensor ids.
SENSORS = {
    100022: Sensor("eagle", 4095, True, "bands"), 110001: Sensor("eagle", 4095, True, "bands"), 300011: Sensor("hawk", 16383, flip="samples"), 310018: Sensor("hawk", 16383, flip="samples"),
    350005: Sensor("fenix", 4095), 350002: Sensor("fenix", 4095),
}
FENIX_RAW_MAX = {"vnir": 4095, "swir": 65535}


def fenix_raw_max(part: str, spatial_binning: int) -> int:
    """The largest raw value of a sub-sensor, raised by binning if that still fits 16 bits."""
    value = FENIX_RAW_MAX[part]
    return value * spatial_binning if value * spatial_binning < MAX_VALUE else value


def dark_mean(dark: DataFrame, value: str = "value") -> DataFrame:
    """A1. The frame counter's cell (band 0, sample 0) has the mean 0."""
    mean = F.when((F.col("band") == 0) & (F.col("sample") == 0), F.lit(0.0)).otherwise(F.avg(value))
    return dark.groupBy(*PIXEL).agg(mean.alias("mean"))


def dark_std(dark: DataFrame, value: str = "value") -> DataFrame:
    """A2. A single frame has the deviation 0."""
    return dark.groupBy(*PIXEL).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def dark_refined(dark: DataFrame, value: str = "value", sigmas: float = 3.0) -> DataFrame:
    """A3. The mean of values within sigmas deviations; few tells that under half of them are."""
    stats = dark.groupBy(*PIXEL).agg(F.avg(value).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("s"), F.count(value).alias("frames"))
    inside = dark.join(stats, PIXEL).filter(F.abs(F.col(value) - F.col("m")) <= sigmas * F.col("s"))
    refined = inside.groupBy(*PIXEL).agg(F.avg(value).alias("mean"), F.count(value).alias("kept"), F.first("frames").alias("frames"))
    corner = (F.col("band") == 0) & (F.col("sample") == 0)
    return refined.select(*PIXEL, F.when(corner, F.lit(0.0)).otherwise(F.col("mean")).alias("mean"), "kept", (F.col("kept") < F.col("frames") / 2).alias("few"))


def flag_pixels(cells: DataFrame, dark: DataFrame | None, raw_max: int, bad: DataFrame | None = None, qc: DataFrame | None = None, eagle: bool = False, lower_band: int = 0) -> DataFrame:
    """C1. Adds mask; values at the counter cells and at or under the dark mean become 0.

    dark has (band, sample, mean), bad and qc have (band, sample).
    """
    if dark is not None:
        cells = cells.join(dark.select(*PIXEL, F.col("mean").alias("_dark")), PIXEL, "left")
    else:
        cells = cells.withColumn("_dark", F.lit(None).cast("double"))
    counter = (F.col("band") == 0) & F.col("sample").isin(0, 1) if lower_band == 0 else F.lit(False)
    over, under = F.col("value") == raw_max, F.col("_dark").isNotNull() & (F.col("value") <= F.col("_dark"))
    mask = F.when(counter, BADPIXEL).when(over, OVERFLOW).when(under, UNDERFLOW).otherwise(0)
    if eagle:
        before = Window.partitionBy("line", "sample").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        smeared = F.coalesce(F.max((over & ~counter).cast("int")).over(before), F.lit(0))
        mask = mask.bitwiseOR(smeared * SMEAR)
    cells = cells.withColumns({"mask": mask.cast("int"), "value": F.when(counter, 0.0).when(over, F.col("value")).when(under, 0.0).otherwise(F.col("value"))}).drop("_dark")
    for table, bit in ((bad, BADPIXEL), (qc, QC)):
        if table is not None:
            marked = table.select(*PIXEL).distinct().withColumn("_bit", F.lit(bit))
            cells = cells.join(marked, PIXEL, "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("_bit", F.lit(0)))).drop("_bit")
    return cells


def remove_dark(cells: DataFrame, dark: DataFrame, raw_max: int | None = None) -> DataFrame:
    """C2, J3. Values of 0 and of 65535 stay; a dark mean over raw_max is an error."""
    mean = F.col("mean")
    if raw_max is not None:
        mean = F.when(mean > raw_max, F.raise_error(F.lit(f"a dark mean is over the largest raw value, {raw_max}")).cast("double")).otherwise(mean)
    cells = cells.join(dark.select(*PIXEL, mean.alias("_dark")), PIXEL, "left")
    less = F.col("value") - F.coalesce("_dark", F.lit(0.0))
    usable = (F.col("value") != 0) & (F.col("value") < MAX_VALUE)
    low = usable & (less <= 0)
    return cells.withColumns({"value": F.when(low, 0.0).when(usable, less).otherwise(F.col("value")), "mask": F.when(low, F.col("mask").bitwiseOR(UNDERFLOW)).otherwise(F.col("mask"))}).drop("_dark")


def smear_factor(integration_ms: float, spectral_binning: int = 1) -> float:
    return SMEAR_SECONDS / integration_ms * spectral_binning


def smear_spectrum(spectrum: Column, factor: float) -> Column:
    """Each band less factor times the sum of the corrected bands before it, not under 0. The first band stays."""

    def corrected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # One pass over the bands for all spectra of a batch; as columns each step would copy the bands before it.
        for batch in batches:
            out = [None] * len(batch)
            sizes = batch.map(lambda x: -1 if x is None else len(x)).to_numpy()
            for size in np.unique(sizes[sizes >= 0]):
                rows = np.flatnonzero(sizes == size)
                x = np.stack(batch.iloc[rows].to_list()).astype(float) if size else np.zeros((len(rows), 0))
                total = np.zeros(len(rows))
                for band in range(1, size):
                    total += x[:, band - 1]
                    x[:, band] = np.maximum(x[:, band] - factor * total, 0)
                for row, values in zip(rows, x, strict=True):
                    out[row] = values
            yield pd.Series(out)

    return F.pandas_udf(corrected, "array<double>")(spectrum)


def smear_correct(cells: DataFrame, factor: float) -> DataFrame:
    """C3 on cells: spectra are collected by (line, sample), whose size is the number of bands."""
    spectra = cells.groupBy("line", "sample").agg(F.array_sort(F.collect_list(F.struct("band", "value", "mask"))).alias("c"))
    fixed = smear_spectrum(F.transform("c", lambda x: x["value"]), factor)
    spectra = spectra.select("line", "sample", F.explode(F.arrays_zip(F.col("c").alias("c"), fixed.alias("v"))).alias("x"))
    low = (F.col("x.v") == 0) & (F.col("x.c.value") > 0)
    mask = F.when(low, F.col("x.c.mask").bitwiseOR(UNDERFLOW)).otherwise(F.col("x.c.mask"))
    return spectra.select("line", "sample", F.col("x.c.band").alias("band"), F.col("x.v").alias("value"), mask.alias("mask"))


def apply_gains(cells: DataFrame, gains: DataFrame, integration_ms: float) -> DataFrame:
    """C4, J4. gains has (band, sample, gain); results from 65535 on are held there and flagged."""
    cells = cells.join(gains.select(*PIXEL, "gain"), PIXEL, "left")
    usable = (F.col("value") != 0) & (F.col("value") != MAX_VALUE)
    scaled = F.col("value") * F.col("gain") * (GAIN_SCALE / integration_ms)
    over = usable & (scaled >= MAX_VALUE)
    return cells.withColumns({"value": F.when(over, float(MAX_VALUE)).when(usable, scaled).otherwise(F.col("value")), "mask": F.when(over, F.col("mask").bitwiseOR(OVERFLOW)).otherwise(F.col("mask"))}).drop("gain")


def binning_ratio(raw: int, calibration: int) -> int:
    """A whole ratio of at least 1."""
    if calibration < 1 or raw % calibration or raw < calibration:
        raise ValueError(f"raw binning {raw} is no whole multiple of calibration binning {calibration}")
    return raw // calibration


def bin_gains(gains: DataFrame, spectral: int, spatial: int, fenix: bool = False) -> DataFrame:
    """Sums over blocks, divided by spectral^2 (spectral on Fenix) times spatial^2 (spatial)."""
    divisor = spectral * spatial if fenix else spectral**2 * spatial**2
    if fenix:
        divisor = spectral * spatial**2
    block = lambda c, n: F.floor(F.col(c) / n).cast("long").alias(c)
    return gains.groupBy(block("band", spectral), block("sample", spatial)).agg((F.sum("gain") / divisor).alias("gain"))


def bin_wavelengths(wavelengths: DataFrame, ratio: int) -> DataFrame:
    """The mean of each `ratio` consecutive wavelengths (band, wavelength)."""
    return wavelengths.groupBy(F.floor(F.col("band") / ratio).cast("long").alias("band")).agg(F.avg("wavelength").alias("wavelength"))


def match_wavelengths(raw: DataFrame, calibration: DataFrame, tolerance: float = WAVELENGTH_TOLERANCE) -> DataFrame:
    """For each raw band the first calibration band within the tolerance; (band, cal_band), null where none is.

    A band join as an equi-join: wavelengths fall into cells of the tolerance, and a match is in the own or a neighbouring cell.
    Equal wavelengths are matched once, by the first band among equal ones, so copies of a band cost no pairs.
    """
    cell = F.floor(F.col("wavelength") / tolerance).cast("long")
    left = raw.select("wavelength").distinct().select("wavelength", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = calibration.groupBy(F.col("wavelength").alias("cal_wavelength")).agg(F.min("band").alias("cal_band")).withColumn("cell", F.floor(F.col("cal_wavelength") / tolerance).cast("long"))
    near = left.join(right, "cell").filter(F.abs(F.col("wavelength") - F.col("cal_wavelength")) <= tolerance).groupBy("wavelength").agg(F.min("cal_band").alias("cal_band"))
    return raw.select("band", "wavelength").join(near, "wavelength", "left").groupBy("band").agg(F.min("cal_band").alias("cal_band"))


def trim_gains(gains: DataFrame, bands: DataFrame) -> DataFrame:
    """Gains by raw band, over match_wavelengths' rows."""
    return bands.filter("cal_band IS NOT NULL").join(gains.withColumnRenamed("band", "cal_band"), "cal_band").select("band", "sample", "gain")


def remap_bad_pixels(bad: DataFrame, bands: DataFrame) -> DataFrame:
    """Bad pixels by raw band; those of bands not in use are dropped."""
    return bad.withColumnRenamed("band", "cal_band").join(bands.filter("cal_band IS NOT NULL"), "cal_band").drop("cal_band")


def average_fodis(cells: DataFrame, lower: int, upper: int) -> DataFrame:
    """By line and band the mean of the non-zero samples in [lower, upper), 0 if none, at most 65535."""
    inside = F.when((F.col("sample") >= lower) & (F.col("sample") < upper) & (F.col("value") != 0), F.col("value"))
    return cells.groupBy("line", "band").agg(F.least(F.coalesce(F.avg(inside), F.lit(0.0)), F.lit(float(MAX_VALUE))).alias("fodis"))


def flip(cells: DataFrame, axis: str, size: int) -> DataFrame:
    """Reverses bands or samples."""
    return cells.withColumn(axis, F.lit(size - 1) - F.col(axis))


def frame_deltas(lines: DataFrame, by: str = "flight") -> DataFrame:
    """Adds delta, the step of the 16-bit counter (column frame) from the line before, wraps undone; null on the first.

    A counter that stands still or goes back is an error.
    """
    step = F.col("frame") - F.lag("frame").over(Window.partitionBy(by).orderBy("line"))
    step = F.when(step <= -(COUNTER_WRAP - 3), step + COUNTER_WRAP).otherwise(step)
    return lines.withColumn("delta", F.when(step <= 0, F.raise_error(F.lit("the frame counter does not rise")).cast("long")).otherwise(step))


def missing_frames(lines: DataFrame, by: str = "flight") -> DataFrame:
    """The number of frames that are missing between lines, by flight."""
    return frame_deltas(lines, by).groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("delta") > 1, F.col("delta") - 1)), F.lit(0)).cast("long").alias("missing"))


def fill_gaps(lines: DataFrame, by: str = "flight") -> DataFrame:
    """Lines with their new numbers (out_line) and, before each gap's end, empty ones that are masked as dropped.

    Numbers come from a running sum of the steps: no second sort over all lines.
    """
    own = frame_deltas(lines, by)
    at = F.sum(F.when(F.col("delta").isNull(), 0).otherwise(F.greatest("delta", F.lit(1)))).over(Window.partitionBy(by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("out_line", at.cast("long"))
    filler = own.filter("delta > 1").select(by, F.explode(F.sequence(F.col("out_line") - F.col("delta") + 1, F.col("out_line") - 1)).alias("out_line"))
    filler = filler.select(by, F.lit(None).cast("long").alias("line"), "out_line", F.lit(DROPPED).alias("mask"))
    return own.select(by, "line", "out_line", F.lit(0).alias("mask")).unionByName(filler)


def boundary_shift(before_jump: int, after_jump: int, sensor_id: int, force: bool = False) -> int:
    """How far the first dark line moves, from the counter's jumps into and out of it."""
    if before_jump == after_jump:
        if sensor_id == 110001:
            return 1
        if force:
            return 0
        raise ValueError("the frame counter does not tell light lines from dark ones")
    return 0 if before_jump > after_jump else 1


def override_corrupt(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Listed lines have the value 0 and the mask of corrupt data."""
    listed = lines.select("line").distinct().withColumn("_corrupt", F.lit(True))
    cells = cells.join(listed, "line", "left")
    return cells.withColumns({"value": F.when(F.col("_corrupt"), 0.0).otherwise(F.col("value")), "mask": F.when(F.col("_corrupt"), CORRUPT).otherwise(F.col("mask"))}).drop("_corrupt")


def select_lines(cells: DataFrame, start: int, end: int) -> DataFrame:
    """Lines in [start, end)."""
    if start >= end:
        raise ValueError("the first line must come before the last")
    return cells.filter((F.col("line") >= start) & (F.col("line") < end))


def trim_lines(cells: DataFrame, start: int, end: int) -> DataFrame:
    """Lines of [start, end], numbered from 0."""
    return cells.filter(F.col("line").between(start, end)).withColumn("line", F.col("line") - start)


def select_bands(text: str, bands: int) -> list[int]:
    """0-based bands from `ALL`, `a-b` or a list of numbers from 1, in their order."""
    if text.strip().upper() == "ALL":
        return list(range(bands))
    out: list[int] = []
    for part in text.replace(",", " ").split():
        low, dash, high = part.partition("-")
        if dash and int(low) >= int(high):
            raise ValueError(f"band range {part} is not ascending")
        out += range(int(low) - 1, int(high if dash else low))
    if not out or min(out) < 0 or max(out) >= bands:
        raise ValueError(f"bands {text} are not all within 1 to {bands}")
    return out


def crop_samples(cells: DataFrame, lower: int, upper: int) -> DataFrame:
    """Samples of [lower, upper], numbered from 0."""
    return cells.filter(F.col("sample").between(lower, upper)).withColumn("sample", F.col("sample") - lower)


def merge_methods(bad: DataFrame) -> DataFrame:
    """Rows (band, sample, method letter) to the union of their bits."""
    bits = F.lit(0)
    for letter, bit in METHODS.items():
        bits = F.when(F.upper("method") == letter, bit).otherwise(bits)
    return bad.groupBy(*PIXEL).agg(F.bit_or(bits).alias("method"))


def merge_masks(masks: DataFrame) -> DataFrame:
    """The union of all masks of a cell."""
    return masks.groupBy("line", "sample", "band").agg(F.bit_or("mask").alias("mask"))


def shape_of(cells: DataFrame) -> tuple[int, int, int]:
    """Lines, bands and samples of a cube, from its largest indices."""
    r = cells.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)) for c in ("line", "band", "sample")]).first()
    return tuple(int(x) for x in r)


def check_shapes(first: DataFrame, *others: DataFrame) -> None:
    """Cubes that are joined cell by cell must have the same lines, bands and samples."""
    shapes = [shape_of(c) for c in (first, *others)]
    if len(set(shapes)) > 1:
        raise ValueError(f"cubes differ in lines, bands or samples: {shapes}")


def mask_level1(level1: DataFrame, mask: DataFrame, method: DataFrame | None = None, flags: int = 127, methods: int | None = None, check: bool = True) -> DataFrame:
    """Level-1 values (line, band, sample, value) joined with their mask and bad-pixel method, and masked."""
    if check:
        check_shapes(level1, mask, *([] if method is None else [method]))
    cell = ["line", "band", "sample"]
    cells = level1.join(mask.select(*cell, "mask"), cell)
    if method is not None:
        cells = cells.join(method.select(*cell, "method"), cell)
    return apply_mask(cells, flags, methods if method is not None else None)


def check_integration(raw_ms: float, dark_ms: float) -> None:
    """A4: dark frames must have the integration time of the raw ones."""
    if raw_ms != dark_ms:
        raise ValueError(f"raw lines were integrated for {raw_ms} ms, dark ones for {dark_ms} ms")


def output_dimensions(lines: DataFrame, lower: int, upper: int, gaps: bool = True, by: str = "flight") -> DataFrame:
    """Lines and samples of each flight's product: its lines, with the missing ones if gaps are filled, and upper - lower + 1 samples."""
    own = frame_deltas(lines, by).groupBy(by).agg(F.count("*").alias("own"), F.coalesce(F.sum(F.when(F.col("delta") > 1, F.col("delta") - 1)), F.lit(0)).alias("missing"))
    return own.select(by, (F.col("own") + (F.col("missing") if gaps else 0)).cast("long").alias("lines"), F.lit(upper - lower + 1).cast("long").alias("samples"))


def apply_mask(cells: DataFrame, flags: int = 127, methods: int | None = None) -> DataFrame:
    """P8, J1 over cells that carry mask and, if methods is given, method: cells with a chosen bit become 0.

    The bad-pixel bit counts only for the chosen methods.
    """
    if not 0 < flags <= 127:
        raise ValueError("flags must hold bits of 1 to 64")
    mask = F.col("mask")
    bad = mask.bitwiseAND(flags & BADPIXEL) != 0
    if methods is not None:
        bad = bad & (F.coalesce("method", F.lit(0)).bitwiseAND(methods) != 0)
    return cells.withColumn("value", F.when((mask.bitwiseAND(flags & ~BADPIXEL) != 0) | bad, 0.0).otherwise(F.col("value")))


def dropped_scans(masks: DataFrame) -> DataFrame:
    """The lines whose first cell is flagged as dropped."""
    return masks.filter((F.col("band") == 0) & (F.col("sample") == 0) & (F.col("mask").bitwiseAND(DROPPED) != 0)).select("line").distinct()


def calibrate(cells: DataFrame, dark: DataFrame | None, gains: DataFrame | None, raw_max: int, integration_ms: float, bad: DataFrame | None = None, qc: DataFrame | None = None, eagle: bool = False, smear: float | None = None, flip_axis: str = "", size: int = 0) -> DataFrame:
    """The kernel in its fixed order: flags, dark, smear, gains, flips. A step without its table is left out (P10)."""
    cells = flag_pixels(cells, dark, raw_max, bad, qc, eagle)
    if dark is not None:
        cells = remove_dark(cells, dark, raw_max)
    if smear is not None:
        cells = smear_correct(cells, smear)
    if gains is not None:
        cells = apply_gains(cells, gains, integration_ms)
    return flip(cells, flip_axis, size) if flip_axis else cells


def sensor_of(sensor_id: int) -> Sensor:
    """An unknown sensor is an error."""
    if sensor_id not in SENSORS:
        raise ValueError(f"sensor {sensor_id} is not known")
    return SENSORS[sensor_id]


def calibrate_sensor(cells: DataFrame, sensor_id: int, dark: DataFrame | None, gains: DataFrame | None, integration_ms: float, size: int, bad: DataFrame | None = None, qc: DataFrame | None = None, part: str | None = None, spectral_binning: int = 1, spatial_binning: int = 1) -> DataFrame:
    """The kernel as a sensor needs it: its largest raw value, smear on Eagle only, bad pixels on the others only (S23), its flip.

    part: vnir or swir for one detector of a Fenix, whose cubes are calibrated each and joined afterwards.
    """
    sensor = sensor_of(sensor_id)
    if (sensor.family == "fenix") != (part is not None):
        raise ValueError("a Fenix is calibrated by its parts, other sensors are whole")
    raw_max = fenix_raw_max(part, spatial_binning) if part else sensor.raw_max
    smear = smear_factor(integration_ms, spectral_binning) if sensor.eagle else None
    axis = {"bands": "band", "samples": "sample", "": ""}[sensor.flip]
    return calibrate(cells, dark, gains, raw_max, integration_ms, None if sensor.eagle else bad, qc, sensor.eagle, smear, axis, size)
