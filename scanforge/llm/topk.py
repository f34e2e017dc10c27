"""Exact top-k search (operator 6) by distributed histogram selection.

Vectors are quantised to integers, so scores are exact. For each block of queries, every pass scores
all candidates and counts, per query, the scores in each of BINS parts of the query's current score
range; summed over the tasks, the counts tell in which part the kth score lies, and that part is the
next range. A range of one score ends it: that is the kth value. A last pass keeps the scores from
there on; a task passes on at most k rows per query, those that come first among its own, which is
exact, so ties (thousands of equal vectors) do not gather anywhere.

Scores are matrix products over Arrow batches. A block's queries (about QUERY_BLOCK rows, a bound
that does not grow) are what is broadcast. A pass shuffles non-empty counts only. Vectors that are
null or hold null or non-finite components take no part; shorter vectors, empty ones too, count as
padded by zeros. Products are sums of float64, exact up to 2**53. Repeated rows are candidates each; the hits of a repeated query are ranked together. A query's
own id is never a candidate; null ids take no part. Fewer candidates than k: all of them. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SCALE = 256
BINS = 256
QUERY_BLOCK = 2048
HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, finite) & F.col(id_col).isNotNull()
    # floor() gives longs; doubles of 2**53 or more are whole as they are.
    down = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return vectors.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: down(x.cast("double") * scale)).alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    values, lengths = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    for row, (start, n) in enumerate(zip(offsets[:-1] - offsets[0], np.minimum(lengths, width), strict=True)):
        out[row, :n] = values[start : start + n]
    return out


def _block(vectors: DataFrame, queries: Column, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """One block of the queries, on the driver: about QUERY_BLOCK rows."""
    rows = vectors.filter(queries).filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").toArrow()
    width = max((len(x) for x in rows.column("vector").to_pylist()), default=0)
    return rows.column("vec_id").to_numpy(), _matrix(rows.column("vector").combine_chunks(), width) if len(rows) else np.zeros((0, 0))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, query_block: int = QUERY_BLOCK, bins: int = BINS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) over quantised vectors; queries is a condition on vec_id."""
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    parts = max(1, -(-vectors.filter(queries).count() // query_block))
    found = None
    for part in range(parts):
        ids, matrix = _block(vectors, queries, part, parts)
        if len(ids):
            hits = _search(vectors, ids, matrix, k, bins)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # At most k rows per query and task arrive here.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, bins: int) -> DataFrame:
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast((ids, matrix))
    width = matrix.shape[1]

    def scores(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own, q = held.value
        c = batch.column(0).to_numpy()
        s = q @ _matrix(batch.column(1), width).T
        s[own[:, None] == c[None, :]] = -np.inf  # the query's own row
        return c, s

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full(len(ids), np.inf), np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
        for batch in batches:
            _, s = scores(batch)
            there = np.isfinite(s)
            n += there.sum(1)
            low = np.minimum(low, np.where(there, s, np.inf).min(1, initial=np.inf))
            high = np.maximum(high, s.max(1, initial=-np.inf))
        q = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(low[q].astype(np.int64)), pa.array(high[q].astype(np.int64)), pa.array(n[q])], ["q", "low", "high", "n"])

    ranges = vectors.mapInArrow(extremes, "q long, low long, high long, n long")
    first = ranges.groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()  # a row per query of the block
    # The kth highest score lies in [low, high]; above counts the scores over high.
    low, high, above = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
    q = first["q"].to_numpy()
    low[q], high[q] = first["low"], first["high"]
    few = q[first["n"].to_numpy() <= k]
    high[few] = low[few]  # all rows are wanted
    while (high > low).any():
        step = np.maximum(1, -(-(high - low + 1) // bins))
        span = spark.sparkContext.broadcast((low, high, step))

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, step = span.value
            total = np.zeros((len(ids), bins), np.int64)
            busy = np.flatnonzero(high > low)
            for batch in batches:
                _, s = scores(batch)
                s = s[busy]
                inside = (s >= low[busy, None]) & (s <= high[busy, None])
                rows, cols = np.nonzero(inside)
                at = ((s[rows, cols] - low[busy][rows]) // step[busy][rows]).astype(np.int64)
                total[busy] += np.bincount(rows * bins + at, minlength=len(busy) * bins).reshape(-1, bins)
            rows, cols = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(total[rows, cols])], ["q", "bin", "n"])

        # Per query, the first bin from the top with which the count reaches k: one row per query comes back.
        summed = vectors.mapInArrow(counts, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        limit = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(ids)), "need": k - above}))
        reached = summed.withColumn("down", down).join(F.broadcast(limit), "q").filter((F.col("down") >= F.col("need")) & (F.col("down") - F.col("n") < F.col("need")))
        got = reached.select("q", "bin", (F.col("down") - F.col("n")).alias("over")).toPandas()
        q, at = got["q"].to_numpy(), got["bin"].to_numpy()
        above[q] += got["over"].to_numpy()
        new = low[q] + at * step[q]
        low[q], high[q] = new, np.minimum(new + step[q] - 1, high[q])
    bound = spark.sparkContext.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = held.value
        none = np.empty(0, np.int64)
        rows, found, values = none, none, none
        for batch in batches:
            c, s = scores(batch)
            r, j = np.nonzero(s >= bound.value[:, None])
            rows, found, values = np.concatenate((rows, r)), np.concatenate((found, c[j])), np.concatenate((values, s[r, j].astype(np.int64)))
            order = np.lexsort((found, -values, rows))
            rows, found, values = rows[order], found[order], values[order]
            start = np.searchsorted(rows, rows)  # the first of the row's query
            best = np.arange(len(rows)) - start < k
            rows, found, values = rows[best], found[best], values[best]
        yield pa.RecordBatch.from_arrays([pa.array(own[rows], pa.int64()), pa.array(found), pa.array(values)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(keep, HITS)

