"""Benchmark decontamination (operator 9) by latent semantic retrieval.

Benchmark items are cut into passages, a distributed table. A passage is a TF-IDF row over hashed word
features; document frequencies are those of all passages. A randomised SVD of all rows (Gaussian test
matrix, power iterations with orthonormal bases; products are summed over the rows' tasks) gives the
latent space, whose rank is at most half the number of passages. Each passage's latent vector and words
are written to files of about BLOCK passages in the shared folder, which workers map into memory: only
the basis, at most FEATURES x RANK floats, is broadcast, however large the benchmark is.

Documents are read once, whole, and stay where they are. Their words' latent vectors are summed in
steps of STEP words; windows of several steps, about as long as the passage, have a cosine with each
passage, and windows that reach COSINE and hold at least HELD of the passage's latent length are
candidates. A candidate counts if the longest common subsequence of words with the passage, around the
window, has at least LCS_SURE of the passage, or LCS_LEAST of it and the answer check holds: the item's
answer (if the benchmark has a column for it), or else at least half of the passage's rarest words,
stands there too. That keeps paraphrases that change the wording between. Passages of fewer than SHORT
words must stand there whole and in order; as runs of words they are searched everywhere.

Words are separated by space and 0x09-0x0D, their case folded over Unicode. Null and empty items match
nothing, nor do null and empty texts. Repeated rows and items are matched each; hits are distinct pairs
with their best figures. Extra columns are kept by decontaminated() and ignored by hits(); empty tables
give no hits. The result does not depend on how passages are dealt to files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Columns, file_of, get, new_path, pieces, put, stored, word_hashes

PASSAGE, SHORT, BLOCK = 96, 8, 4096
STEP, STEPS = 8, (2, 4, 6, 9, 12)
FEATURES, RANK, OVERSAMPLE, POWER = 1 << 15, 128, 16, 2
COSINE, HELD = 0.45, 0.4
LCS_SURE, LCS_LEAST, RARE = 0.8, 0.6, 4
#: Windows and passages whose cosines are held together.
_WINDOWS, _PASSAGES, _CHUNK = 2048, 1024, 1024
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_ROW = "item long, words binary, given binary"


def folded_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of the texts with case folded in every script, not A-Z only."""
    return word_hashes([t and t.casefold() for t in texts])


def features(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(FEATURES)).astype(np.int64)


def passages(benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """item, words and given (the answer's words) of each passage; hashes are packed."""
    answer = F.col(answer_col) if answer_col else F.lit(None)
    rows = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text", answer.cast("string").alias("answer")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, given = folded_hashes([text])[0], folded_hashes([answer])[0]
                out += [(item, p.tobytes(), given.tobytes()) for p in np.array_split(words, max(1, -(-len(words) // PASSAGE))) if len(p)]
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["item", "words", "given"])

    return rows.mapInArrow(cut, _ROW)


def sparse_row(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's features and TF-IDF values, of length 1 together."""
    at, tf = np.unique(features(words), return_counts=True)
    value = tf * idf[at]
    return at, value / np.linalg.norm(value)


def randomised_svd(rows: DataFrame, width: int, rank: int, row_of, power: int = POWER, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors (width x rank) of the sparse rows that row_of(batch) yields as (columns, values).

    Each product A'(A Q) is summed by chunks of columns in the executors; only matrices of the fixed
    width come to the driver.
    """

    def product(q: np.ndarray) -> np.ndarray:
        held = rows.sparkSession.sparkContext.broadcast(q)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = held.value
            out = np.zeros((width, q.shape[1]))
            for batch in batches:
                for at, value in row_of(batch):
                    out[at] += value[:, None] * (value @ q[at])
            starts = [s for s in range(0, width, _CHUNK) if out[s : s + _CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([out[s : s + _CHUNK].tobytes() for s in starts], pa.binary())], ["start", "sums"])

        def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"start": [key[0]], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

        out = np.zeros((width, q.shape[1]))
        for r in rows.mapInArrow(partial, "start long, sums binary").groupBy("start").applyInPandas(total, "start long, sums binary").collect():
            part = np.frombuffer(bytes(r["sums"])).reshape(-1, q.shape[1])
            out[r["start"] : r["start"] + len(part)] = part
        held.unpersist()
        return out

    size = min(width, rank + OVERSAMPLE)
    basis = np.random.default_rng(seed).standard_normal((width, size))
    for _ in range(power):
        basis = np.linalg.qr(product(basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    keep = np.argsort(-values)[: min(rank, int((values > 1e-9 * max(values.max(), 1e-300)).sum()))]
    return basis @ vectors[:, keep]


class Block:
    """A file of passages."""

    def __init__(self, columns: Columns, rank: int):
        self.items, self.starts, self.words = columns["item"], columns["start"], columns["word"]
        self.sizes = np.diff(self.starts)
        self.latent = columns["latent"].reshape(-1, rank)
        self.needs, self.ordered = (columns["need_start"], columns["need"]), columns["ordered"]
        self.masks: dict[int, dict[int, int]] = {}
        # A passage's window has about its length.
        self.steps = np.array(STEPS)[np.abs(self.sizes[:, None] - np.array(STEPS) * STEP).argmin(1)]
        self.runs = {}
        for size in np.unique(self.sizes[self.sizes < SHORT]).tolist():
            ids = np.flatnonzero(self.sizes == size)
            h = np.array([rolled(self.passage(i), size)[0] for i in ids.tolist()], np.uint64)
            order = np.argsort(h, kind="stable")
            self.runs[size] = h[order], ids[order]

    def passage(self, p: int) -> np.ndarray:
        return self.words[self.starts[p] : self.starts[p + 1]]

    def mask(self, p: int) -> dict[int, int]:
        if p not in self.masks:
            self.masks[p] = places(self.passage(p).tolist())
        return self.masks[p]

    def needed(self, p: int) -> np.ndarray:
        starts, words = self.needs
        return words[starts[p] : starts[p + 1]]


@dataclass
class Index:
    """The benchmark in its latent space; blocks of passages are files in `folder`."""

    folder: str
    blocks: list[int]
    rows: np.ndarray  # of each feature its row of the basis, the last one for features of no passage
    basis: np.ndarray  # idf times the right singular vectors, and a last row of zeros

    def block(self, number: int) -> Block:
        held = self.__dict__.setdefault("_held", {})
        if number not in held:
            held[number] = Block(Columns(get(self.folder, f"passages-{number}", np.uint8)), self.basis.shape[1])
        return held[number]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_held"}


def build(benchmark: DataFrame, answer_col: str | None = None, rank: int = RANK, block: int = BLOCK) -> Index | None:
    spark = benchmark.sparkSession
    table = stored(passages(benchmark, answer_col), "passages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for words in batch.column(1).to_pylist():
                seen[np.unique(features(np.frombuffer(words, np.uint64)))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["feature", "n"])

    counts = table.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas().set_index("feature")["n"]  # a row per feature
    n = int(counts.get(-1, 0))
    if not n:
        return None
    present = np.sort(counts.index[counts.index >= 0].to_numpy())
    idf = np.zeros(FEATURES)
    idf[present] = np.log((n + 1) / counts[present].to_numpy()) + 0.1
    place = np.full(FEATURES, len(present))
    place[present] = np.arange(len(present))
    weights = spark.sparkContext.broadcast((idf, place))

    def row_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        idf, place = weights.value
        for words in batch.column(1).to_pylist():
            at, value = sparse_row(np.frombuffer(words, np.uint64), idf)
            yield place[at], value

    basis = randomised_svd(table, len(present), max(1, min(rank, n // 2)), row_of)
    basis = np.vstack((idf[present, None] * basis, np.zeros((1, basis.shape[1])))).astype(np.float32)
    held = spark.sparkContext.broadcast(basis)
    folder = new_path(spark, "latent")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, place = weights.value
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        number = TaskContext.get().partitionId()
        if rows:
            words = [np.frombuffer(w, np.uint64) for _, w, _ in rows]
            needs = []
            for w, (_, _, given) in zip(words, rows, strict=True):
                own = np.unique(w)
                # The answer, which must stand there in order, or the rarest words, of which half must.
                needs.append(np.frombuffer(given, np.uint64) if given else own[np.argsort(-idf[features(own)], kind="stable")][: max(1, len(own) // RARE)])
            starts = lambda x: np.concatenate(([0], np.cumsum([len(y) for y in x]))).astype("<i8")
            latent = np.stack([held.value[place[features(w)]].sum(0) for w in words]).astype("<f4")
            ordered = np.array([bool(g) for _, _, g in rows], np.uint8)
            put(folder, f"passages-{number}", file_of({"item": np.array([i for i, _, _ in rows], "<i8"), "start": starts(words), "word": np.concatenate(words), "latent": latent.ravel(), "need_start": starts(needs), "need": np.concatenate(needs), "ordered": ordered}, {}))
        yield pa.RecordBatch.from_arrays([pa.array([number] if rows else [], pa.int64())], ["block"])

    numbers = [r["block"] for r in table.repartition(-(-n // block), "item").mapInArrow(write, "block long").collect()]  # a number per file
    return Index(folder, sorted(set(numbers)), place, basis)


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    out = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        out = out * _PRIME + words[k : k + len(out)]
    return out


def places(words: list[int]) -> dict[int, int]:
    """For each word the bits of its places."""
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_subsequence(n: int, masks: dict[int, int], other: list[int]) -> int:
    """The length of the longest common subsequence with n words given by places(), by bit operations over whole rows."""
    full = row = (1 << n) - 1
    for w in other:
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _stands(sequence: np.ndarray, near: np.ndarray) -> bool:
    if len(sequence) == 1:
        return bool((near == sequence[0]).any())
    return common_subsequence(len(sequence), places(sequence.tolist()), near.tolist()) == len(sequence)


def candidates(index: Index, block: Block, sums: np.ndarray, first: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(first step, passage, cosine) of windows near a passage; sums has a row for each step of STEP words, first the text's first step."""
    last = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(owner) - 1)[owner - owner[0]] if len(owner) else owner
    total = np.concatenate((np.zeros((1, sums.shape[1])), np.cumsum(sums, 0, dtype=np.float64)))
    for k in np.unique(block.steps[block.sizes >= SHORT]).tolist():
        own = np.flatnonzero((block.steps == k) & (block.sizes >= SHORT))
        # A text's windows: all with k whole steps, or all of a shorter text.
        begin = np.flatnonzero((np.arange(len(owner)) + k - 1 <= last) | (np.arange(len(owner)) == first))
        w = (total[np.minimum(begin + k, last[begin] + 1)] - total[begin]).astype(np.float32)
        length = np.sqrt((w * w).sum(1))
        some = length > 1e-6
        begin, w, length = begin[some], w[some], length[some]
        for p in range(0, len(own), _PASSAGES):
            ids = own[p : p + _PASSAGES]
            latent = block.latent[ids]
            norm = np.sqrt((latent * latent).sum(1))
            for a in range(0, len(begin), _WINDOWS):
                dot = w[a : a + _WINDOWS] @ latent.T
                near = (dot >= COSINE * length[a : a + _WINDOWS, None] * norm) & (dot >= HELD * norm * norm)
                for i, j in zip(*np.nonzero(near), strict=True):
                    yield int(begin[a + i]), int(ids[j]), float(dot[i, j] / (length[a + i] * norm[j]))


def matches(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, float, float]]:
    """(text number, item, cosine, lcs share) for each passage found, the best for each pair."""
    hashes, bounds = folded_hashes(texts)
    if not len(hashes):
        return
    lengths = np.diff(bounds)
    steps = -(-lengths // STEP)
    owner = np.repeat(np.arange(len(lengths)), steps)
    first = np.repeat(np.concatenate(([0], np.cumsum(steps)[:-1])), steps)
    start = bounds[owner] + (np.arange(len(owner)) - first) * STEP
    # The words' rows, STEP to a step, filled up with the row of zeros; by parts, so that vectors do not stand together.
    none = len(index.basis) - 1
    word = start[:, None] + np.arange(STEP)
    rows = np.where(word < bounds[owner + 1][:, None], index.rows[features(hashes)][np.minimum(word, len(hashes) - 1)], none)
    sums = np.empty((len(start), index.basis.shape[1]), np.float32)
    for a in range(0, len(start), 2048):
        part = index.basis[rows[a : a + 2048, 0]]
        for k in range(1, STEP):
            part += index.basis[rows[a : a + 2048, k]]
        sums[a : a + 2048] = part
    rank_of = np.cumsum(np.concatenate(([0], (owner[1:] != owner[:-1]).astype(int))))
    best: dict[tuple[int, int], tuple[float, float]] = {}

    def judge(block: Block, text: int, p: int, s: int, e: int, cosine: float) -> None:
        n = int(block.sizes[p])
        around = hashes[max(bounds[text], s - n) : min(bounds[text + 1], e + n)]
        share = common_subsequence(n, block.mask(p), around.tolist()) / n
        if share < (1.0 if n < SHORT else LCS_LEAST):
            return
        if share < LCS_SURE:
            need = block.needed(p)
            if block.ordered[p]:
                if common_subsequence(len(need), places(need.tolist()), around.tolist()) < len(need):
                    return
            elif 2 * np.isin(need, around).sum() < len(need):
                return
        key = (text, int(block.items[p]))
        best[key] = max(best.get(key, (0.0, -1.0)), (share, cosine))

    for number in index.blocks:
        block = index.block(number)
        for step, p, cosine in candidates(index, block, sums, first, rank_of):
            s = int(start[step])
            judge(block, int(owner[step]), p, s, s + int(block.steps[p]) * STEP, cosine)
        for size, (runs, ids) in block.runs.items():
            h = rolled(hashes, size)
            low, high = np.searchsorted(runs, h), np.searchsorted(runs, h, "right")
            for s in np.flatnonzero(high > low).tolist():
                text = int(np.searchsorted(bounds, s, "right")) - 1
                if s + size <= bounds[text + 1]:
                    for p in ids[low[s] : high[s]].tolist():
                        judge(block, text, p, s, s + size, 1.0)
    for (text, item), (share, cosine) in best.items():
        yield text, item, cosine, share


def hits(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """Distinct doc_id, item_id with cosine and lcs (the best shares found)."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, cosine double, lcs double"
    index = build(benchmark, answer_col)
    if index is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for a, b, texts in pieces(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                rows += [(ids[i], *m) for i, *m in matches(held.value, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "cosine", "lcs"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, in which no passage is found."""
    index = build(benchmark, answer_col)
    if index is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(index)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, texts in pieces(batch.column("text")):
                for i, *_ in matches(held.value, texts):
                    keep[a + i] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
