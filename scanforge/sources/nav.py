"""Navigation files: SBET, SOL, NMEA text and binary logs, and lists of bad pixels.

Binary records are read whole-file per task by Spark's binary reader, so any store will do; a file is
one flight's log. Text is read by Spark's text reader.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nmea_degrees
from ..operators.calibration import METHODS

SCHEMA = "file string, seq long, time double, lat double, lon double, hei double, roll double, pitch double, heading double"
#: Sizes and fields of records.
SBET = np.dtype([("time", "<f8"), ("lat", "<f8"), ("lon", "<f8"), ("hei", "<f8"), ("v", "<f8", 3), ("roll", "<f8"), ("pitch", "<f8"), ("heading", "<f8"), ("wander", "<f8"), ("rest", "<f8", 6)])
SOL = np.dtype([
    ("head", "u1", 14), ("time_type", "u1", 2), ("week", "<u2"), ("times", "<f8", 2), ("checksum", "u1"), ("origin", "u1", 7), ("lat", "<f8"), ("lon", "<f8"), ("hei", "<f8"), ("position_error", "<f4", 3),
    ("roll", "<f8"), ("pitch", "<f8"), ("heading", "<f8"), ("attitude_error", "<f4", 3), ("velocity", "<f8", 3), ("velocity_error", "<f4", 3), ("rates", "<f8", 3), ("undulation", "<f4"), ("geoid", "u1"), ("rest", "u1", 5),
])
BINARY_NAV = np.dtype([("tag", "<i2"), ("time", "<f8"), ("roll", "<i2"), ("pitch", "<i2"), ("heading", "<u2"), ("lat", "<i4"), ("lon", "<i4"), ("hei", "<u2"), ("unused", "<u2")])
NAV_TAG, SYNC_TAG = -28160, -32257
SYNC_BYTES = {999: 14, 998: 16}


def _per_file(spark: SparkSession, path: str, parse, schema: str = SCHEMA) -> DataFrame:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                out = parse(content)
                out.insert(0, "file", name)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def parse_sbet(content: bytes) -> pd.DataFrame:
    """Degrees; heading (made positive) less the wander angle."""
    if len(content) % SBET.itemsize:
        raise ValueError("an SBET file must hold whole records of 136 bytes")
    r = np.frombuffer(content, SBET)
    heading = np.degrees(r["heading"])
    heading = np.where(heading < 0, heading + 360, heading) - np.degrees(r["wander"])
    return pd.DataFrame({"seq": np.arange(len(r)), "time": r["time"], "lat": np.degrees(r["lat"]), "lon": np.degrees(r["lon"]), "hei": r["hei"], "roll": np.degrees(r["roll"]), "pitch": np.degrees(r["pitch"]), "heading": heading})


def read_sbet(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, parse_sbet)


def read_nmea(spark: SparkSession, path: str, altitude_fields: tuple[int, int] = (9, 11)) -> DataFrame:
    """One record per $PRDID with the position before it; times are seconds of the day, unrolled over midnight by operators.navigation.

    Malformed sentences are skipped. altitude_fields: the fields of $GPGGA whose sum is the height.
    """
    from pyspark.sql.window import Window

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.split(F.regexp_replace("value", r"\*.*$", ""), ",").alias("f"))
    kind, n = F.col("f")[0], F.size("f")
    field = lambda i: F.col("f")[i]
    number = lambda i: field(i).try_cast("double")
    second = F.substring(field(1), 1, 2).try_cast("int") * 3600 + F.substring(field(1), 3, 2).try_cast("int") * 60 + F.substring(field(1), 5, 12).try_cast("double")
    fix = F.when((kind == "$GPGGA") & (n == 15) & second.isNotNull() & number(2).isNotNull() & number(4).isNotNull(), F.struct(
        second.alias("time"), nmea_degrees(number(2), field(3)).alias("lat"), nmea_degrees(number(4), field(5)).alias("lon"), (F.coalesce(number(altitude_fields[0]), F.lit(0.0)) + F.coalesce(number(altitude_fields[1]), F.lit(0.0))).alias("hei")))
    own = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("fix", F.last(fix, True).over(own)).filter((kind == "$PRDID") & (n == 4) & number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull() & F.col("fix").isNotNull())
    return rows.select("file", "seq", "fix.*", number(2).alias("roll"), number(1).alias("pitch"), number(3).alias("heading"))


def read_syncs(spark: SparkSession, path: str) -> DataFrame:
    """$SPTSMP and $SPTSMP2 sentences in order: (file, seq, per_second, fields)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.split(F.regexp_replace("value", r"\*.*$", ""), ",").alias("f"))
    good = ((F.col("f")[0] == "$SPTSMP") & (F.size("f") == 4)) | ((F.col("f")[0] == "$SPTSMP2") & (F.size("f") == 2))
    return lines.filter(good).select("file", "seq", (F.col("f")[0] == "$SPTSMP").alias("per_second"), F.slice("f", 2, 3).alias("fields"))


#: Fixed values: $GPZDA has 8 fields, its day, month and year are the third to the fifth.
_ZDA = ("$GPZDA", 8, 2)


def prescan(spark: SparkSession, path: str) -> DataFrame:
    """By file the number of good positions and syncs, whether syncs are per second, and the first day's seconds of the week (S14), null without $GPZDA."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.split(F.regexp_replace("value", r"\*.*$", ""), ",").alias("f"))
    kind, n = F.col("f")[0], F.size("f")
    name, size, at = _ZDA
    day = F.when((kind == name) & (n == size), F.try_to_date(F.concat_ws("-", F.col("f")[at + 2], F.col("f")[at + 1], F.col("f")[at]), "y-M-d"))
    counted = lines.groupBy("file").agg(
        F.count_if((kind == "$GPGGA") & (n == 15)).alias("positions"), F.count_if((kind == "$SPTSMP2") & (n == 2)).alias("syncs"),
        F.count_if((kind == "$SPTSMP") & (n == 4)).alias("second_syncs"), F.min_by(day, F.when(day.isNotNull(), F.col("seq"))).alias("day"))
    return counted.select("file", "positions", F.greatest("syncs", F.when(F.col("syncs") == 0, F.col("second_syncs")).otherwise(0)).alias("syncs"), ((F.col("syncs") == 0) & (F.col("second_syncs") > 0)).alias("per_second"), ((F.dayofweek("day") - 1) * 86400).cast("long").alias("week_seconds"))


def parse_sol(content: bytes) -> pd.DataFrame:
    """Records of 184 bytes; the time is the first of the two whose type is GPS (1)."""
    if len(content) % SOL.itemsize:
        raise ValueError("a SOL file must hold whole records of 184 bytes")
    r = np.frombuffer(content, SOL)
    gps = r["time_type"] == 1
    if not gps.any(1).all():
        raise ValueError("neither time of a SOL record is GPS time")
    time = np.where(gps[:, 0], r["times"][:, 0], r["times"][:, 1])
    heading = np.degrees(r["heading"])
    return pd.DataFrame({"seq": np.arange(len(r)), "time": time, "lat": np.degrees(r["lat"]), "lon": np.degrees(r["lon"]), "hei": r["hei"], "roll": np.degrees(r["roll"]), "pitch": np.degrees(r["pitch"]), "heading": np.where(heading < 0, heading + 360, heading)})


def read_sol(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, parse_sol)


def _binary_log(content: bytes) -> tuple[list[tuple], list[tuple]]:
    """Records and syncs by their tags; after a byte that starts none, the next byte is tried, and no sync is trusted before a record."""
    at, rows, syncs, sound = 0, [], [], True
    while at + 4 <= len(content):
        tag = int.from_bytes(content[at : at + 2], "little", signed=True)
        kind = int.from_bytes(content[at + 2 : at + 4], "little")
        if tag == NAV_TAG and at + BINARY_NAV.itemsize <= len(content):
            r = np.frombuffer(content, BINARY_NAV, 1, at)[0]
            rows.append((float(r["time"]), r["lat"] / 3.6e6, r["lon"] / 3.6e6, r["hei"] / 10, r["roll"] / 100, r["pitch"] / 100, r["heading"] / 100))
            at, sound = at + BINARY_NAV.itemsize, True
        elif tag == SYNC_TAG and sound and kind in SYNC_BYTES and at + SYNC_BYTES[kind] <= len(content):
            if kind == 999 and rows:
                syncs.append((int(rows[-1][0] + 1), int.from_bytes(content[at + 10 : at + 12], "little") / 1000))
            at += SYNC_BYTES[kind]
        else:
            at, sound = at + 1, False
    return rows, syncs


def parse_binary_nav(content: bytes) -> pd.DataFrame:
    out = pd.DataFrame(_binary_log(content)[0], columns=["time", "lat", "lon", "hei", "roll", "pitch", "heading"], dtype=float)
    out.insert(0, "seq", np.arange(len(out)))
    return out


def parse_binary_syncs(content: bytes) -> pd.DataFrame:
    """Whole GPS seconds after each sync message, and the delay to them."""
    out = pd.DataFrame(_binary_log(content)[1], columns=["gps", "delay"])
    out.insert(0, "seq", np.arange(len(out)))
    return out.astype({"gps": "int64", "delay": float})


def read_binary_syncs(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, parse_binary_syncs, "file string, seq long, gps long, delay double")


def read_binary_nav(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, parse_binary_nav)


def sniff(path: str) -> str:
    """Sbet, sol, nmea or binary, from a local file's size, name and first bytes."""
    size, extension = os.path.getsize(path), os.path.splitext(path)[1]
    sbet, sol = size % SBET.itemsize == 0, size % SOL.itemsize == 0
    if sbet and sol:
        return {".out": "sbet", ".sol": "sol"}.get(extension, "sbet")
    if sbet or sol:
        return "sbet" if sbet else "sol"
    with open(path, "rb") as f:
        return "nmea" if b"$GPGGA" in f.read(1 << 20) else "binary"


def contiguous(ids: DataFrame) -> Column:
    """True, if ids are the numbers from 1 to as many as there are; else an error. Distinct ids with that least and greatest have no gap."""
    n = ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("a"), F.max("id").alias("z")).first()
    if n["n"] and (n["d"] != n["n"] or n["a"] != 1 or n["z"] != n["n"]):
        raise ValueError("the ids of bad pixels are not the numbers from 1 on")
    return F.lit(True)


def read_bad_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(band, sample, method) of the facility's form (`headerlines=N`, 0-based, methods A,B) or the vendor's (first line with `320 256`, 1-based)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("value"))
    first = lines.orderBy("n").first()
    part = F.split("value", r"\s+")
    if first is not None and "320 256" in first["value"]:
        rows = lines.filter(F.col("n") > first["n"]).filter(F.size(part) >= 3)
        rows = rows.filter(contiguous(rows.select(part[0].try_cast("long").alias("id"))))
        return rows.select((part[2].cast("long") - 1).alias("band"), (part[1].cast("long") - 1).alias("sample"), F.lit(0).alias("method")).distinct()
    rows = lines.filter(F.col("value").rlike(r"^\d+\s+\d+\s+\d+\s+[A-Fa-f,]+$"))
    bits = F.aggregate(F.split(F.upper(part[3]), ","), F.lit(0), lambda s, m: s.bitwiseOR(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), m), F.lit(0))))
    return rows.select(part[1].cast("long").alias("band"), part[2].cast("long").alias("sample"), bits.alias("method")).groupBy("band", "sample").agg(F.bit_or("method").alias("method"))


def read_qc_failures(spark: SparkSession, path: str, bands: int, samples: int) -> DataFrame:
    """(band, sample); an error for text that is no pair of numbers in range."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(part[0].try_cast("long").alias("band"), part[1].try_cast("long").alias("sample"))
    good = F.coalesce((F.col("band") >= 0) & (F.col("band") < bands) & (F.col("sample") >= 0) & (F.col("sample") < samples), F.lit(False))
    return rows.select(F.when(good, F.col("band")).otherwise(F.raise_error(F.lit("a line of the QC list is not a band and a sample in range"))).alias("band"), "sample")
