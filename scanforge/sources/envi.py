"""ENVI cubes: header text, a Spark data source for BIL and BSQ files, and a writer.

`spark.read.format("envi").load(path)` gives a row for each line and band: (line, band, values).
Tasks read ranges of lines; filters on line and band are pushed down to the bytes that are read.
Paths are opened by the workers, so they must be on storage that all workers mount.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Data type codes. Complex types (6, 9) are refused.
TYPES = {1: "<u1", 2: "<i2", 3: "<i4", 4: "<f4", 5: "<f8", 12: "<u2", 13: "<u4", 14: "<i8", 15: "<u8"}
LINES_PER_TASK_BYTES = 64 << 20


def parse_header(text: str) -> dict[str, list[str]]:
    """Keys in lower case; `{...}` lists over several lines are split at commas, other values are lists of one. Comments (`;`) with `=` count as keys too."""
    out: dict[str, list[str]] = {}
    for key, braces, plain in re.findall(r"^[ \t]*;?[ \t]*([^=\n;{}][^=\n{}]*?)[ \t]*=[ \t]*(?:\{([^}]*)\}|([^\n]*))", text, re.M):
        out[key.strip().lower()] = [x.strip() for x in re.split(r"[,\n]", braces) if x.strip()] if braces else [plain.strip()]
    return out


def header_path(path: str) -> str:
    for candidate in (f"{path[:-3]}hdr", f"{path}.hdr", f"{os.path.splitext(path)[0]}.hdr"):
        if os.path.exists(candidate):
            return candidate
    raise FileNotFoundError(f"no header for {path}")


def read_header(path: str) -> dict[str, list[str]]:
    with open(header_path(path), encoding="latin-1") as f:
        return parse_header(f.read())


def format_header(items: dict[str, object]) -> str:
    """Header text; lists in braces, one item on each line."""
    lines = ["ENVI"]
    for key, value in items.items():
        many = isinstance(value, (list, tuple))
        lines.append(f"{key} = {{{',\n '.join(map(str, value))}}}" if many else f"{key} = {value}")
    return "\n".join(lines) + "\n"


def copied_header(header: dict[str, list[str]], reverse_bands: bool = False) -> dict[str, object]:
    """A header's items for a product, without those of its layout; wavelengths reversed with the bands."""
    own = {"bands", "samples", "lines", "data type", "envi", "interleave", "description"}
    out = {k: v if len(v) > 1 else v[0] for k, v in header.items() if k not in own}
    if reverse_bands:
        out |= {k: out[k][::-1] for k in ("wavelength", "fwhm") if isinstance(out.get(k), list)}
    return out


def map_info(kind: str, left: float, top: float, x_size: float, y_size: float, zone: int = 0, south: bool = False) -> list[str]:
    """K14."""
    start = ["1", "1", f"{left:.10g}", f"{top:.10g}", f"{x_size:.10g}", f"{y_size:.10g}"]
    if kind == "utm":
        return ["UTM", *start, str(zone), "South" if south else "North", "WGS-84", "units=Meters"]
    if kind == "osng":
        return ["British National Grid", *start, "Ordnance Survey of Great Britain '36", "units=Meters"]
    if kind == "latlong":
        return ["Geographic Lat/Lon", *start, "WGS-84", "units=Degrees"]
    return [kind, *start]


class Layout:
    """Where a file's cells are; the size is checked."""

    def __init__(self, path: str):
        h = read_header(path)
        number = lambda k: int(h[k][0])
        self.path, self.lines, self.samples, self.bands = path, number("lines"), number("samples"), number("bands")
        self.interleave = h.get("interleave", ["bil"])[0].lower()
        if self.interleave not in ("bil", "bsq"):
            raise ValueError(f"interleave {self.interleave} is not supported")
        code = number("data type")
        if code not in TYPES:
            raise ValueError(f"data type {code} is not supported")
        self.type = np.dtype(TYPES[code]).newbyteorder(">" if h.get("byte order", ["0"])[0] == "1" else "<")
        self.offset = int(h.get("header offset", ["0"])[0])
        size, expected = os.path.getsize(path) - self.offset, self.lines * self.samples * self.bands * self.type.itemsize
        if size != expected:
            raise ValueError(f"{path} has {size} bytes; its header says {expected}")

    def cube(self) -> np.ndarray:
        """The file mapped as (line, band, sample)."""
        shape = (self.lines, self.bands, self.samples) if self.interleave == "bil" else (self.bands, self.lines, self.samples)
        cells = np.memmap(self.path, self.type, "r", self.offset, shape)
        return cells if self.interleave == "bil" else cells.transpose(1, 0, 2)


class LineRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class EnviReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.bounds = options, {"line": [0, 1 << 62], "band": [0, 1 << 62]}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name not in self.bounds or not isinstance(value, int):
                yield f
                continue
            low, high = self.bounds[name]
            if isinstance(f, EqualTo):
                low, high = max(low, value), min(high, value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = max(low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = min(high, value + isinstance(f, LessThanOrEqual))
            else:
                yield f
                continue
            self.bounds[name] = [low, high]

    def partitions(self) -> list[LineRange]:
        out = []
        for path in sorted(glob.glob(self.options["path"])):
            a = Layout(path)
            step = max(1, LINES_PER_TASK_BYTES // (a.samples * a.bands * a.type.itemsize))
            low, high = self.bounds["line"]
            out += [LineRange(path, s, min(s + step, a.lines, high)) for s in range(max(0, low), min(a.lines, high), step)]
        return out

    def read(self, part: LineRange) -> Iterator[pa.RecordBatch]:
        a = Layout(part.path)
        low, high = max(0, self.bounds["band"][0]), min(a.bands, self.bounds["band"][1])
        cube = a.cube()
        for line in range(part.start, part.end):
            block = np.ascontiguousarray(cube[line, low:high]).astype(np.float64)
            n = high - low
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.samples, pa.int32()), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.full(n, line, np.int32)), pa.array(np.arange(low, high, dtype=np.int32)), values], ["file", "line", "band", "values"])


class EnviSource(DataSource):
    """S2, S3."""

    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return "file string, line int, band int, values array<double>"

    def reader(self, schema: StructType) -> EnviReader:
        return EnviReader(dict(self.options))


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, line, band, values)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EnviSource)
    return spark.read.format("envi").option("path", path).load()


def joined_header(headers: list[dict[str, list[str]]]) -> dict[str, list[str]]:
    """The header of single-band files as one cube: wavelengths and widths one after the other; other items must agree."""
    many = {"wavelength", "fwhm", "band names"}
    out = {k: [v for h in headers for v in h.get(k, [])] for k in many if k in headers[0]}
    for key, value in headers[0].items():
        if key in many or key == "bands":
            continue
        if any(h.get(key) != value for h in headers):
            raise ValueError(f"the files' headers differ in {key}")
        out[key] = value
    return out | {"bands": [str(len(headers))]}


def read_multifile(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Single-band files as the bands of one cube; their sizes and types must agree."""
    layouts = [Layout(p) for p in paths]
    if len({(a.lines, a.samples, a.bands, a.type) for a in layouts}) != 1 or layouts[0].bands != 1:
        raise ValueError("files of one cube must have one band each, and the same size and type")
    joined_header([read_header(p) for p in paths])
    out = None
    for band, path in enumerate(paths):
        one = read_cube(spark, path).withColumn("band", F.lit(band))
        out = one if out is None else out.unionByName(one)
    return out


def cells(bands: DataFrame) -> DataFrame:
    """Band lines as cells (line, band, sample, value)."""
    return bands.select("line", "band", F.posexplode("values").alias("sample", "value"))


def band_lines(cells: DataFrame) -> DataFrame:
    """Cells as band lines; a group is one line of samples."""
    return cells.groupBy("line", "band").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("v")).select("line", "band", F.transform("v", lambda x: x["value"]).alias("values"))


def narrow(value: Column, code: int, round_half: bool = True, clamp: bool = False) -> Column:
    """K2, K4 as a column: whole values of a file's type, or doubles for its floating types."""
    kind = np.dtype(TYPES[code])
    if kind.kind == "f":
        return value.cast("float" if kind.itemsize == 4 else "double")
    whole = F.floor(value + 0.5) if round_half else value.cast("long")
    limits = np.iinfo(kind)
    if clamp:
        whole = F.greatest(F.lit(int(limits.min)), F.least(F.lit(int(min(limits.max, 2**63 - 1))), whole))
    return whole.cast("long") if kind.itemsize == 8 or kind == np.dtype("<u4") else whole.cast("int")


def narrowed(values: np.ndarray, code: int, round_half: bool = True, clamp: bool = False) -> np.ndarray:
    """K2, K4: values in a file's type: half a unit is added before integers are cut (K2), or not (K4); clamp holds them in range."""
    kind = np.dtype(TYPES[code])
    if kind.kind == "f":
        return values.astype(kind)
    values = np.floor(values + 0.5) if round_half else np.trunc(values)
    if clamp:
        limits = np.iinfo(kind)
        values = np.clip(values, limits.min, limits.max)
    return values.astype(np.int64).astype(kind)


def write_bil(bands: DataFrame, path: str, code: int, lines: int, samples: int, n_bands: int, header: dict | None = None, **how) -> None:
    """K1: rows (line, band, values) to a BIL file on storage that workers mount; each task writes its band lines in place.

    Places are fixed by line and band, so a task that is repeated writes the same bytes again.
    """
    size = np.dtype(TYPES[code]).itemsize * samples
    with open(path, "wb") as f:
        f.truncate(size * lines * n_bands)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as f:
            for batch in batches:
                for line, band, values in zip(*(batch.column(c).to_pylist() for c in ("line", "band", "values")), strict=True):
                    f.seek((line * n_bands + band) * size)
                    f.write(narrowed(np.array(values, float), code, **how).tobytes())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    written = bands.select("line", "band", "values").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if written != lines * n_bands:
        raise ValueError(f"{written} band lines were written of {lines * n_bands}")
    with open(f"{os.path.splitext(path)[0]}.hdr", "w", encoding="latin-1") as f:
        f.write(format_header({"samples": samples, "lines": lines, "bands": n_bands, "data type": code, "interleave": "bil", "byte order": 0} | (header or {})))
