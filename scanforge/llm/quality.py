"""Quality classifier (operator 5): histogram gradient-boosted trees over document statistics.

Statistics are array arithmetic over whole texts, batch by batch; nothing but the text enters them.
Trees are grown on the driver from quantile-binned statistics of a bounded sample of labelled rows
(SAMPLE rows, those with the smallest hashed ids; at most as many ids are what is broadcast), flattened into arrays
of complete trees, and walked level by level for all rows of a batch at once. Scoring has no shuffle.

Null texts are empty. Empty texts get the score of their (zero) statistics. Several labels for one
document count as the lowest; labels that are null or have no document are left out. Without any
label of either kind all scores are the share of label 1, or 0.5 without labels. Repeated rows are
scored each; extra columns are kept by keep_good() and ignored by score().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, word_hashes

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 80, 4, 64, 0.15, 1.0

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=/\\_+;", b"'\"`:-", b"\n", b" \t\r"]
_CLASS = np.zeros((256, len(_CLASSES) + 1))
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c), _i] = 1
_CLASS[128:, -1] = 1


def _per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a word-level array for each document."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of document statistics for each text."""
    return np.concatenate([_statistics(part) for _, _, part in pieces(texts)]) if len(texts) else np.zeros((0, _width()))


def _width() -> int:
    return _statistics([""]).shape[1]


def _statistics(texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(b) for b in raw], np.float64)
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), size.astype(np.int64))
    counts = np.bincount(owner * 256 + buffer, minlength=256 * len(raw)).reshape(-1, 256).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -np.sum(share * np.log2(share, where=share > 0, out=np.zeros_like(share)), 1)
    hashes, bounds = word_hashes(texts)
    n = np.diff(bounds).astype(float)
    whole = np.maximum(n, 1)
    document = np.repeat(np.arange(len(raw)), np.diff(bounds))
    order = np.lexsort((hashes, document))
    h, d = hashes[order], document[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    distinct = np.bincount(d[new], minlength=len(raw))
    most = np.zeros(len(raw))
    np.maximum.at(most, d[new], runs)
    once = np.bincount(d[new][runs == 1], minlength=len(raw))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
    lines = [b.split(b"\n") for b in raw]
    n_lines = np.array([len(x) for x in lines], float)
    same = np.array([len(set(x)) for x in lines], float)
    words = [b.split() for b in raw]
    lengths = np.fromiter((len(w) for ws in words for w in ws), np.float64)
    at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    n_split = np.maximum(np.diff(at), 1)
    mean_length = _per_document(lengths, at) / n_split
    return np.column_stack([
        share @ _CLASS, entropy, np.log1p(n), mean_length, _per_document(lengths <= 3, at) / n_split, _per_document(lengths >= 14, at) / n_split,
        np.sqrt(np.maximum(0, _per_document(lengths**2, at) / n_split - mean_length**2)), distinct / whole, once / whole, most / whole,
        _per_document(again, bounds) / whole, same / n_lines, n / n_lines,
    ])


@dataclass
class Model:
    """Complete trees of one depth, flattened: node i of tree t has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1] if len(self.feature) else 0
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Model:
    """Newton boosting of the logistic loss on histograms of gradients."""
    rate = float(y.mean()) if len(y) else 0.5
    inner = (1 << depth) - 1
    if not len(y) or not 0 < rate < 1:
        base = 0.0 if not len(y) else 6.0 if rate else -6.0
        return Model(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    offset = np.arange(width) * bins
    base = float(np.log(rate / (1 - rate)))
    margin, fs, ts, vs = np.full(n, base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            start, many = (1 << level) - 1, 1 << level
            key = ((at - start)[:, None] * (width * bins) + offset + binned).ravel()
            shape = (many, width, bins)
            G = np.bincount(key, np.repeat(g, width), many * width * bins).reshape(shape).cumsum(2)
            H = np.bincount(key, np.repeat(h, width), many * width * bins).reshape(shape).cumsum(2)
            tg, th = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + SMOOTH) + (tg - G) ** 2 / (th - H + SMOOTH) - tg**2 / (th + SMOOTH)
            gain[(H < 1) | (th - H < 1)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for node in range(many):
                j, b = divmod(int(best[node]), bins)
                if gain[node, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[start + node], threshold[start + node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = RATE * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + SMOOTH)
        margin += leaf[at - inner]
        fs.append(feature), ts.append(threshold), vs.append(leaf)
    return Model(np.array(fs), np.array(ts), np.array(vs), base)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents for which `usable` (a condition on doc_id) holds."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    known = known if usable is None else known.filter(usable)
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

    # An id may be repeated without bound, so rows are counted again. Sorted, the model does not depend on how rows arrive.
    found = rows.select("doc_id", "text", "y").mapInArrow(measured, "doc_id long, x array<double>, y double")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).select("x", "y").toArrow()
    if not len(got):
        return fit(np.zeros((0, _width())), np.zeros(0))
    x, y = np.array(got.column("x").to_pylist()), got.column("y").to_numpy()
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id and score for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(statistics(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = held.value.scores(statistics(batch.column("text"))) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)
