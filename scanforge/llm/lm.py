"""LM scoring (operator 7): an interpolated modified Kneser-Ney trigram model.

Counting. Each task counts the distinct words of its own texts, then their trigrams, and passes them on
packed: for each bucket one row of sorted, delta-coded and compressed arrays. Buckets are the top bits
of hashes, so they are even whatever the words are; trigrams go by the hash of their first two words.
A bucket's task merges its rows and writes its part of the model: the bigrams it holds, with their
counts as contexts, and the words that follow each. It passes on how many trigrams end in each bigram,
to the task of that bigram's bucket, which writes these continuation counts and passes on statistics by
word, in ranges of word ids that follow the vocabulary's size.

The model is a folder of flat files in the shared folder. Words and bigrams are sorted hash arrays;
counts take a byte each, with the few larger ones beside them. Words are ranked by hash, a bigram's
hash is a bijection of its two word ids, and a trigram is found among the sorted words that follow
its context, so nothing collides. Workers map the files into memory and look up batches by binary
search; nothing of the corpus passes through the driver but a row of totals for each bucket. Files
are written under another name and renamed, so a task that is repeated after a lost executor writes
the same again.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; each text begins after two
start tokens and ends with one end token. Null and empty texts are that end token alone. Repeated
rows count, and are scored, each. Null ids are training rows. Without training rows every token has
probability 1 / (V + 1) = 1. Word ids have 32 bits: a larger vocabulary is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _M1, _M2, Columns, file_of, get, mixed, new_path, pieces, put, word_hashes

#: Input bytes for each bucket of words, and training tokens for each bucket of bigrams.
BUCKET_BYTES, BUCKET_TOKENS = 16 << 20, 2_000_000
#: Words of a task, and tokens, that are counted together.
HELD_WORDS, HELD = 4_000_000, 3_000_000
#: The most word ids in one file of statistics.
RANGE = 1 << 16
#: Bigrams of a file that share one sum of words before them.
GROUP = 8
END = np.uint64(0x5E0D5E0D5E0D5E0D)
_LOW, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)
_PACKED = "bucket long, keys binary, counts binary"
_INVERSE = [np.uint64(pow(int(m), -1, 1 << 64)) for m in (_M2, _M1)]


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of mixed()."""
    for shift, inverse in ((31, _INVERSE[0]), (27, _INVERSE[1]), (30, None)):
        y = x
        for _ in range(64 // shift):
            y = x ^ (y >> np.uint64(shift))
        x = y if inverse is None else y * inverse
    return x


# --- packed arrays ---------------------------------------------------------------------------------
def squeeze(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed; runs and small numbers take little."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def spread(b: bytes) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), b[8]
    planes = np.frombuffer(pa.decompress(b[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.zeros(1, x.dtype)))


def spread_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(spread(b), dtype=np.uint64)


# --- words and n-grams ------------------------------------------------------------------------------
def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end token after each text, and the bounds of texts."""
    words, bounds = word_hashes(texts)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def shifted(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token; `start` before a text's first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1]] = start
    return out


def bigram(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << _32) | second.astype(np.uint64)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted keys begin."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
    return np.flatnonzero(new)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = starts_of(k)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _added(keys: list[np.ndarray], counts: list[np.ndarray], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts by (key, word), sorted by them."""
    k, w, c = np.concatenate(keys), np.concatenate(words), np.concatenate(counts)
    order = np.lexsort((w, k))
    k, w, c = k[order], w[order], c[order]
    first = starts_of(k, w)
    return k[first], w[first], np.add.reduceat(c, first) if len(k) else c


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def bucket_bounds(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (the top bits of a key) starts, and the end."""
    return np.searchsorted(bucket_of(sorted_keys, bits), np.arange((1 << bits) + 1))


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of `wanted` stands in its own sorted range of values, -1 where it does not."""
    low, end = low.copy(), high
    high = high.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        go = low < high
        less = go & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low = np.where(less, middle + 1, low)
        high = np.where(go & ~less, middle, high)
    found = low < end
    found[found] = values[low[found]] == wanted[found]
    return np.where(found, low, -1)


@dataclass
class Model:
    """What is known of the files in `folder`; files are opened by the worker that reads them."""

    folder: str
    bases: np.ndarray  # the first word id of each bucket of words, and V
    train_tokens: int
    word_bits: int
    bits: int = 0
    span: int = RANGE  # word ids in a file of statistics
    discounts: tuple = ((0.5, 1.0, 1.5),) * 3  # of orders 1, 2 and 3
    continuations: int = 0
    backoff: float = 1.0

    @property
    def vocabulary(self) -> int:
        return int(self.bases[-1])

    # Ids beyond the words: a text's start, nothing (after an end), an unknown word.
    start = property(lambda self: self.vocabulary)
    nothing = property(lambda self: self.vocabulary + 1)
    unknown = property(lambda self: self.vocabulary + 2)

    def file(self, name: str) -> Columns:
        files = self.__dict__.setdefault("_files", {})
        if name not in files:
            files[name] = Columns(get(self.folder, name, np.uint8))
        return files[name]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_files"}

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts."""
        unique, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(unique), self.unknown, np.int64), np.zeros(len(unique), np.int64)
        at = bucket_bounds(unique, self.word_bits)
        for b in np.flatnonzero(np.diff(at)):
            own = slice(at[b], at[b + 1])
            if self.bases[b] < self.bases[b + 1]:
                f = self.file(f"words-{b}")
                keys = f["hash"]
                place = np.minimum(np.searchsorted(keys, unique[own]), len(keys) - 1)
                known = keys[place] == unique[own]
                ids[own] = np.where(known, self.bases[b] + place, self.unknown)
                counts[own] = np.where(known, f.counts("count", place), 0)
        return ids[back], counts[back]

    def of_word(self, ids: np.ndarray) -> np.ndarray:
        """Columns total, n1, n2, n3 (as a context: continuations, and words with 1, 2, more of them) and seen (before it), for ids up to V."""
        unique, back = np.unique(ids, return_inverse=True)
        values = np.zeros((5, len(unique)))
        which = unique // self.span
        for r in np.unique(which):
            own = which == r
            if r * self.span <= self.vocabulary:
                f, at = self.file(f"statistics-{r}"), unique[own] - r * self.span
                inside = at < f.head["total"][2]
                values[:, np.flatnonzero(own)[inside]] = [f.counts(c, at[inside]) for c in ("total", "n1", "n2", "n3", "seen")]
        return values[:, back]

    def bigrams(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each bigram, and for those that are known rows (start, end, total, n1, n2, continued)."""
        h = mixed(keys)
        unique, back = np.unique(h, return_inverse=True)
        rows = np.zeros((6, len(unique)), np.int64)
        at = bucket_bounds(unique, self.bits)
        for b in np.flatnonzero(np.diff(at)):
            f = self.file(f"bigrams-{b}")
            known = f["hash"]
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, unique[at[b] : at[b + 1]]), len(known) - 1)
            there = np.flatnonzero(known[place] == unique[at[b] : at[b + 1]])
            place = place[there]
            # A row's words begin after those of the rows before it: the sum at its group of GROUP rows, and its neighbours'.
            near = (place // GROUP * GROUP)[:, None] + np.arange(GROUP)
            degree = f.counts("degree", np.minimum(near, len(known) - 1).ravel()).reshape(near.shape)
            start = f["base"][place // GROUP].astype(np.int64) + (degree * (near < place[:, None])).sum(1)
            rows[:, at[b] + there] = [start, start + f.counts("degree", place), *[f.counts(c, place) for c in ("total", "n1", "n2")], self.file(f"continued-{b}").counts("continued", place)]
        return bucket_of(unique, self.bits)[back], rows[:, back]

    def trigram_counts(self, bucket: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        asked = np.flatnonzero(end > start)
        asked = asked[np.argsort(bucket[asked], kind="stable")]
        for part in np.split(asked, starts_of(bucket[asked])[1:]) if len(asked) else []:
            f = self.file(f"bigrams-{bucket[part[0]]}")
            at = within(f["word"], start[part], end[part], words[part])
            out[part[at >= 0]] = f.counts("count", at[at >= 0])
        return out

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score for each text."""
        hashes, bounds = tokens(texts)
        ids, counts = self.words(hashes)
        v, n = self.vocabulary, self.train_tokens
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        known = ids < v
        p = np.full(len(ids), 1 / (v + 1))
        cut = lambda order, c: np.array([0.0, *self.discounts[order - 1]])[np.minimum(c, 3).astype(int)]
        left = lambda order, *n: sum(d * x for d, x in zip(self.discounts[order - 1], n, strict=True))
        if self.continuations:
            total, n1, n2, n3, _ = self.of_word(shifted(ids, bounds, self.start))
            seen = self.of_word(ids)[4]
            p = (seen - cut(1, seen) + self.backoff * self.continuations * p) / self.continuations
            # Each token's bigram with the word before; its context is the token before's, or the two starts.
            before = shifted(ids, bounds, self.start)
            bucket, rows = self.bigrams(np.append(bigram(before, ids), bigram(np.array([self.start]), np.array([self.start]))))
            c = rows[5, :-1] * known
            usable = total > 0
            p = np.where(usable, (c - cut(2, c) + left(2, n1, n2, n3) * p) / np.where(usable, total, 1), p)
            context = np.arange(len(ids)) - 1
            context[bounds[:-1]] = len(ids)
            start, end, total, n1, n2, _ = rows[:, context]
            usable = total > 0
            c = self.trigram_counts(bucket[context], start, end, ids)
            p = np.where(usable, (c - cut(3, c) + left(3, n1, n2, end - start - n1 - n2) * p) / np.where(usable, total, 1), p)
        sums = lambda x: np.add.reduceat(x, bounds[:-1])
        return [np.diff(bounds), sums(known.astype(np.int64)), sums(base), sums(np.log10(p))]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of modified Kneser-Ney, from how many have the counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    return tuple(min(float(i), max(0.0, i - (i + 1) * y * b / a)) if a else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


_COUNTS = ["n1", "n2", "n3", "n4"]


def _how_many(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def train(docs: DataFrame, usable: Column, text_col: str = "text") -> Model:
    """Counts the rows for which `usable` does not fail to hold, and writes the model."""
    folder = new_path(docs.sparkSession, "lm")
    texts = docs.filter(usable).select(F.col(text_col).alias("text"))
    # Buckets follow the input's size as the plan knows it, so a bucket's task stays as small.
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    word_bits = max(3, min(20, (size // BUCKET_BYTES).bit_length()))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            k, c = _summed(keys, counts)
            at = bucket_bounds(k, word_bits)
            full = np.flatnonzero(np.diff(at)).tolist()
            packed = [[f(x[at[b] : at[b + 1]]) for b in full] for f, x in ((squeeze_sorted, k), (squeeze, c))]
            keys.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], ["bucket", "keys", "counts"])

        for batch in batches:
            for _, _, own in pieces(batch.column(0), 1 << 20):
                k, c = np.unique(tokens(own)[0], return_counts=True)
                keys.append(k), counts.append(c)
                held += len(k)
                if held > HELD_WORDS:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    def write_words(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed([spread_sorted(x) for x in frame["keys"]], [spread(x) for x in frame["counts"]])
        put(folder, f"words-{key[0]}", file_of({"hash": k}, {"count": c}))
        return pd.DataFrame({"bucket": [key[0]], "words": [len(k)], "tokens": [int(c.sum())]})

    sizes = texts.mapInArrow(count_words, _PACKED).groupBy("bucket").applyInPandas(write_words, "bucket long, words long, tokens long").toPandas()  # a row per bucket
    per = np.zeros(1 << word_bits, np.int64)
    per[sizes["bucket"]] = sizes["words"]
    model = Model(folder, np.concatenate(([0], np.cumsum(per))), int(sizes["tokens"].sum()), word_bits, span=RANGE)
    if not model.train_tokens:
        return model
    if model.unknown >= 1 << 32:
        raise ValueError(f"{model.vocabulary} words do not fit ids of 32 bits")
    bits = model.bits = max(0, int(model.train_tokens // BUCKET_TOKENS).bit_length())
    v = model.vocabulary

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, held = [], [], 0

        def flush() -> pa.RecordBatch:
            k, w, c = _added(keys, [np.ones(len(x), np.int64) for x in keys], words)
            keys.clear(), words.clear()
            bucket = bucket_of(mixed(k), bits)
            order = np.argsort(bucket, kind="stable")
            k, w, c, bucket = k[order], w[order], c[order], bucket[order]
            first = starts_of(bucket)
            parts = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(k)], strict=True)]
            packed = [pa.array([squeeze_sorted(k[s] >> _32) for s in parts], pa.binary()), *[pa.array([squeeze(x[s]) for s in parts], pa.binary()) for x in (k & _LOW, w, c)]]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *packed], ["bucket", "first", "second", "third", "counts"])

        for batch in batches:
            for _, _, own in pieces(batch.column(0), 1 << 20):
                hashes, bounds = tokens(own)
                ids, _ = model.words(hashes)
                before = shifted(ids, bounds, model.start)
                # Nothing follows an end; the bigram with it is a context without words.
                last = bounds[1:] - 1
                keys.append(np.concatenate((bigram(shifted(before, bounds, model.start), before), bigram(before[last], ids[last]))))
                words.append(np.concatenate((ids, np.full(len(last), model.nothing))).astype("<u4"))
                held += len(words[-1])
                if held > HELD:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    def write_bigrams(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k, w, c = _added([mixed((spread_sorted(x) << _32) | spread(y)) for x, y in zip(frame["first"], frame["second"], strict=True)], [spread(x).astype(np.int64) for x in frame["counts"]], [spread(x).astype("<u4") for x in frame["third"]])
        whole = w != model.nothing
        first = starts_of(k)
        total, n1, n2 = (np.add.reduceat(x, first) for x in (c * whole, (c == 1) & whole, (c == 2) & whole)) if len(k) else (c,) * 3
        base = (np.cumsum(whole) - whole)[first[::GROUP]].astype("<u8")
        degree = np.add.reduceat(whole.astype(np.int64), first) if len(k) else c
        put(folder, f"bigrams-{key[0]}", file_of({"hash": k[first], "base": base, "word": w[whole]}, {"degree": degree, "total": total, "n1": n1.astype(np.int64), "n2": n2.astype(np.int64), "count": c[whole]}))
        # The same bigrams end trigrams: (second, third).
        second = unmixed(k[whole]) & _LOW
        ends, n = np.unique((second << _32) | w[whole].astype(np.uint64), return_counts=True)
        bucket = bucket_of(mixed(ends), bits)
        order = np.argsort(bucket, kind="stable")
        ends, n, bucket = ends[order], n[order], bucket[order]
        at = starts_of(bucket)
        rows = [(int(bucket[a]), squeeze_sorted(ends[a:b]), squeeze(n[a:b]), 0, 0, 0, 0) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ends)], strict=False)]
        return pd.DataFrame([*rows, (-1 - key[0], b"", b"", *_how_many(c[whole]))], columns=["bucket", "keys", "counts", *_COUNTS])

    def write_continued(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names = ["range", "kind", "ids", "counts", *_COUNTS]
        if key[0] < 0:
            return frame.assign(range=-1, kind=3, ids=b"", counts=b"")[names]
        ends, c = _summed([spread_sorted(x) for x in frame["keys"]], [spread(x).astype(np.int64) for x in frame["counts"]])
        hashes = Columns(get(folder, f"bigrams-{key[0]}", np.uint8))["hash"]
        out = np.zeros(len(hashes), np.int64)
        out[np.searchsorted(hashes, mixed(ends))] = c
        put(folder, f"continued-{key[0]}", file_of({}, {"continued": out}))
        rows = []
        for kind, ids, columns in ((0, (ends >> _32).astype(np.int64), [c, c == 1, c == 2, c > 2]), (1, (ends & _LOW).astype(np.int64), [np.ones(len(c), np.int64)])):
            order = np.argsort(ids, kind="stable")
            first = starts_of(ids[order])
            values = np.stack([np.add.reduceat(x[order].astype(np.int64), first) for x in columns]) if len(ids) else np.zeros((len(columns), 0))
            s = ids[order][first]
            at = starts_of(s // model.span)
            rows += [(int(s[a] // model.span), kind, squeeze_sorted(s[a:b].astype(np.uint64)), squeeze(values[:, a:b].ravel()), 0, 0, 0, 0) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(s)], strict=False)]
        return pd.DataFrame([*rows, (-1, 2, b"", b"", *_how_many(c))], columns=names)

    def write_statistics(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return frame.groupby("kind", as_index=False)[_COUNTS].sum().assign(total=0)[["kind", "total", *_COUNTS]]
        out = np.zeros((5, min(model.span, v + 1 - key[0] * model.span)), np.int64)
        for kind, ids, values in zip(frame["kind"], frame["ids"], frame["counts"], strict=True):
            at = spread_sorted(ids).astype(np.int64) - key[0] * model.span
            out[(slice(4, 5) if kind else slice(0, 4)), at] += spread(values).astype(np.int64).reshape(-1, len(at))
        put(folder, f"statistics-{key[0]}", file_of({}, dict(zip(("total", "n1", "n2", "n3", "seen"), out, strict=True))))
        return pd.DataFrame([(1, int(out[4].sum()), *_how_many(out[4]))], columns=["kind", "total", *_COUNTS])

    trigrams = texts.mapInArrow(count_trigrams, "bucket long, first binary, second binary, third binary, counts binary")
    bigrams = trigrams.groupBy("bucket").applyInPandas(write_bigrams, f"{_PACKED}, n1 long, n2 long, n3 long, n4 long")
    continued = bigrams.groupBy("bucket").applyInPandas(write_continued, "range long, kind int, ids binary, counts binary, n1 long, n2 long, n3 long, n4 long")
    by_range = continued.groupBy("range").applyInPandas(write_statistics, "kind int, total long, n1 long, n2 long, n3 long, n4 long")
    totals = by_range.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("total", *_COUNTS)]).toPandas().set_index("kind")  # a row per order
    model.discounts = tuple(discounts(totals.loc[order, _COUNTS].tolist()) for order in (1, 2, 3))
    model.continuations = int(totals.loc[1, "total"])
    # What the unigrams' discounts leave for the uniform distribution over the vocabulary and one unknown word.
    n1, n2 = totals.loc[1, ["n1", "n2"]].tolist()
    model.backoff = float(np.dot(model.discounts[0], [n1, n2, v - n1 - n2])) / model.continuations
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 of the text's probability) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [held.value.score(texts) for _, _, texts in pieces(batch.column(1), 1 << 21)]
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")
