"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 8 << 20

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='scanforge-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scanforge/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str | None:
    """The path under which workers can open a file of the shared folder, if it is a mounted one."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    """A flat file in the shared folder, whole or not at all."""
    if path := local_path(folder):
        os.makedirs(path, exist_ok=True)
        array.tofile(own := f"{path}/.{name}-{uuid.uuid4().hex}")
        os.replace(own, f"{path}/{name}")
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(array.tobytes())


_LOCAL: dict[str, str] = {}


def get(folder: str, name: str, kind: str) -> np.ndarray:
    """A flat file of the shared folder, memory-mapped; from a store that cannot be mounted a worker's copy of it."""
    path = local_path(folder)
    if path is None:
        from pyarrow import fs

        path = _LOCAL.setdefault(folder, tempfile.mkdtemp())
        if not os.path.exists(f"{path}/{name}"):
            fs.copy_files(f"{folder}/{name}", f"{path}/{name}")
    path = f"{path}/{name}"
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def file_of(columns: dict[str, np.ndarray], counts: dict[str, np.ndarray]) -> np.ndarray:
    """The bytes of a file of columns; counts take a byte each, those of 255 and more stand beside them."""
    arrays = dict(columns)
    for name, x in counts.items():
        large = x >= 255
        arrays[name] = np.where(large, 255, x).astype(np.uint8)
        arrays[f"{name}@"], arrays[f"{name}!"] = np.flatnonzero(large).astype("<u8"), x[large].astype("<u8")
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        raw = x.tobytes()
        head[name] = (x.dtype.str, at, len(x))
        parts.append(raw + bytes(-len(raw) % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return np.frombuffer(b"".join([len(text).to_bytes(8, "little"), text, *parts]), np.uint8)


class Columns:
    """A file of columns, mapped."""

    def __init__(self, raw: np.ndarray):
        size = int.from_bytes(raw[:8].tobytes(), "little")
        # A plain view: slices of memory maps are slow objects.
        self.raw, self.begin, self.head = raw.view(np.ndarray), 8 + size, json.loads(raw[8 : 8 + size].tobytes())

    def __getitem__(self, name: str) -> np.ndarray:
        kind, at, n = self.head[name]
        return self.raw[self.begin + at : self.begin + at + n * np.dtype(kind).itemsize].view(kind)

    def counts(self, name: str, at: np.ndarray) -> np.ndarray:
        out = self[name][at].astype(np.int64)
        if (large := out == 255).any():
            out[large] = self[f"{name}!"][np.searchsorted(self[f"{name}@"], at[large])]
        return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Tables:
    """Tables of one run in the shared folder, which are deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcasting if its rows, counted, fit BROADCAST_BYTES; else df, for a shuffled join."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-spread uint64 from uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mixed(x + np.uint64((int(_GOLD) * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.full(1, 1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), 0x100000001B3, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words start (one entry more than texts).

    Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. All of it is array
    arithmetic over the bytes of the batch: a polynomial hash by segmented sums, then a finaliser.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw))
    buffer = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum(sizes)
    space = _SPACE[buffer]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    last = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    lengths = last - first
    inside = np.flatnonzero(~space)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    terms = (_LOWER[buffer[inside]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    hashes = mixed(np.add.reduceat(terms, starts) + lengths.astype(np.uint64) * _GOLD)
    return hashes, np.concatenate(([0], np.searchsorted(first, ends)))


def slices(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` characters together, so that arrays over them stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of whole texts of about `most` bytes together, with the texts; the others stay in Arrow."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop, column.slice(start, stop - start).to_pylist()
        start = stop
