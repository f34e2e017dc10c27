"""WARC (operator 10): writing archives, and reading them back by boundary-chain verification.

write_warc: Spark's text writer writes one gzip archive per task and record limit, so a lost task
is repeated by the commit protocol and any file system will do. Payloads of at least `least` bytes
that are equal (SHA-1 and length) are stored once: the row with the largest page_id is a response,
the others are revisits that name it. Groups are found on digests alone; payloads are shuffled only if
there are too many revisits to broadcast.

read_warc: tasks cut archives at the version magic, which may also stand inside a payload, and emit
for each candidate its offset and its successor's (offset + header + Content-Length + 4); only header
texts leave the JVM for that. Pointer jumping over an archive's candidates keeps those reachable from
the file's start, and their offsets are written beside the archive's name in the shared folder. A
second pass hashes the payloads of these records alone, piece by piece, one at a time: magic inside a
payload, however often, costs no memory. One task reads one archive (gzip cannot be split; archives
are bounded by `per_file` records). Only offsets and digests are shuffled.

Null html is an empty payload. Rows repeated with the largest page_id are all responses; other rows
refer to that id. Null page_ids come back null and are only chosen as response if no other is there.
Texts are written whole, carriage returns and record magic included. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import get, new_path, put, small, stored

MAGIC = "WARC/1.1\r\n"
LEAST_BYTES = 1000
RECORDS_PER_FILE = 5000
RECORD = "file string, at long, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def with_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "UTF-8"))})
    key = ["payload_digest", "payload_bytes"]
    # Only ids and digests are shuffled, unless there are too many revisits to broadcast.
    keyed = stored(p.filter(F.col("payload_bytes") >= least).select("page_id", *key), "digests")
    kept = keyed.groupBy(key).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = stored(keyed.join(kept, key).filter(F.col("page_id") < F.col("kept")).select("page_id", *key, "kept").distinct(), "revisits")
    p = p.join(small(revisits, 80), ["page_id", *key], "left")
    return p.withColumns({"record_type": F.when(F.col("kept").isNull(), "response").otherwise("revisit"), "refers_to": F.col("kept")}).drop("kept")


def write_warc(pages: DataFrame, path: str, least: int = LEAST_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    p = with_types(pages, least)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    revisit = F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise("")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")), revisit,
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body, F.lit("\r\n\r"),
    )
    p.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _fields(head: str | None) -> dict[str, str] | None:
    """A header's fields, if it is one: lines with colons, and a Content-Length."""
    fields = {}
    for text in (head or "").split("\r\n"):
        name, colon, value = text.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return fields if length.isascii() and length.isdigit() else None


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.removeprefix("-").isdigit() else None


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A row (file, value, head) for what follows each magic, and for what stands before an archive's first."""
    rows = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.withColumn("head", F.when(F.instr("value", "\r\n\r\n") > 0, F.substring_index("value", "\r\n\r\n", 1)))


class _Place:
    """Where a row stands: Spark's reader drops the separator, and all rows but an archive's first follow one."""

    def __init__(self):
        self.file, self.end = None, 0

    def step(self, file: str, size: int) -> int | None:
        """The offset of the magic before the row, None for an archive's first."""
        if file != self.file:
            self.file, self.end = file, size
            return None
        at = self.end
        self.end += len(MAGIC) + size
        return at


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, at and next: for each magic before a header its offset and its successor's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Place()
        for batch in batches:
            out: list[tuple] = []
            for file, size, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = place.step(file, size)
                if at is not None and (fields := _fields(head)):
                    out.append((file, at, at + len(MAGIC) + len(head.encode()) + 4 + int(fields["content-length"]) + 4))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "at", "next"])

    rows = _rows(spark, path).select("file", F.octet_length("value").cast("long").alias("size"), "head")
    return rows.mapInArrow(scan, "file string, at long, next long")


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 visits, by pointer jumping in log2 steps."""
    n = len(at)
    place = np.searchsorted(at, after)
    jump = np.where((place < n) & (at[np.minimum(place, n - 1)] == after), place, n)
    jump = np.append(jump, n)
    seen = np.append(at == 0, False)
    for _ in range(n.bit_length() + 1):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def _name(file: str) -> str:
    return hashlib.sha1(file.encode()).hexdigest()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records reachable from their archive's start. A group here is one archive's candidate offsets."""
    folder = new_path(spark, "chains")

    def chain(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", kind="stable")
        at = frame["at"].to_numpy("<i8")
        kept = at[reachable(at, frame["next"].to_numpy())]
        put(folder, _name(key[0]), kept)
        return pd.DataFrame({"n": [len(kept)]})

    # Written here; the count alone comes back.
    if not candidates(spark, path).groupBy("file").applyInPandas(chain, "n long").agg(F.sum("n")).first()[0]:
        return spark.createDataFrame([], RECORD)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, file, kept, now, begun, digest, missing = _Place(), None, frozenset(), None, 0, None, 0
        for batch in batches:
            out: list[tuple] = []
            for name, value, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = place.step(name, len(value))
                if name != file:
                    file, now = name, None
                    try:
                        kept = frozenset(get(folder, _name(file), "<i8").tolist())
                    except FileNotFoundError:  # an archive without candidates
                        kept = frozenset()
                if at in kept:
                    begun, now, digest = at, _fields(head), hashlib.sha1()
                    missing = int(now["content-length"])
                    piece = value[len(head.encode()) + 4 :]
                else:
                    piece = MAGIC.encode() + value
                if now is None:
                    continue
                digest.update(piece[:missing])
                missing -= min(missing, len(piece))
                if not missing:
                    kind = now.get("warc-type", "")
                    size, sha = int(now["content-length"]), digest.hexdigest()
                    if kind == "revisit":
                        size, sha = int(now.get("x-payload-length", "0")), now.get("warc-payload-digest", "").removeprefix("sha1:")
                    out.append((file, begun, _page(now.get("warc-record-id")), now.get("warc-target-uri"), kind, size, sha, _page(now.get("warc-refers-to"))))
                    now = None
            columns = zip(*out, strict=True) if out else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [c.split()[0] for c in RECORD.split(", ")])

    return _rows(spark, path).select("file", F.col("value").cast("binary").alias("value"), "head").mapInArrow(records, RECORD)
