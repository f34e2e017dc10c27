"""Packing (operator 8): sum-of-squares online packing of token sequences into fixed windows.

Every task packs the documents of its own partition as they come, so there is no shuffle and no
state beyond one level array and the open windows' pieces. A document's whole windows are cut off
first; what is left goes to the fill level that minimises the sum of squared counts of partially
filled windows. At the partition's end the windows still open are merged: pieces of the emptiest
are cut to fill the fullest exactly, and the last one is cut at powers of two, where sequences need
no padding. So no id is padding, at the cost of a few short sequences for each partition.

Null texts are empty; an empty document has its end id alone. Repeated rows are packed once each.
Very long texts are tokenised whole. Extra columns are ignored; an empty table gives no rows.
A sequence's id is its partition's number shifted by 40 bits plus a running number, the same again
if a lost task is repeated over the same input.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
#: Distinct words whose ids a worker keeps; the table is emptied when full.
CACHED_WORDS = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if its ids rank the merges, as byte-level BPE files have them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocabulary.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merged)}


class Encoder:
    """Byte-level BPE ids of whole texts.

    Tokens never reach over a space with no white space after it, so a text's words, each with the
    space before it, have the ids that they have in the text; each distinct word is encoded once. The
    same vocabulary in ranked form gives the ids of `tokenizers` (a test compares them). Texts that hold
    an added token's string, and tokenizers of another kind, go to `tokenizers` itself, text by text.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.encode, self.known = None, {}  # from a word to the packed ids of the word with a space before it
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is None and all(split.get(k) == v for k, v in _BYTE_LEVEL.items()) and (ranks := _byte_ranks(spec["model"])):
            self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.encode is None or self.added and self.added.search(text):
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], "<u4")
        if "  " in text:
            return np.array([*self.encode(text), END_ID], "<u4")
        first, *words = text.split(" ")
        packed, known = list(map(self.known.get, words)), self.known
        if None in packed:
            if len(known) > CACHED_WORDS:
                known.clear()
            for i, ids in enumerate(packed):
                if ids is None:
                    packed[i] = known[words[i]] = array("I", self.encode(" " + words[i])).tobytes()
        return np.frombuffer(b"".join([array("I", self.encode(first)).tobytes(), *packed, _END]), "<u4")


_END = array("I", [END_ID]).tobytes()
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class SumOfSquares:
    """The online packer: levels[f] counts the open windows that hold f ids."""

    def __init__(self, window: int):
        self.window, self.levels, self.open = window, np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]

    def place(self, piece, size: int) -> list | None:
        """Puts a piece of fewer ids than a window; returns the window's pieces if that fills it."""
        n, w = self.levels, self.window
        # Moving a window from level f to f + size changes the sum of squares by this; f = 0 opens one.
        cost = 2 * (n[size:w] - n[: w - size]) + 2
        cost[0] = 2 * n[size] + 1
        full = 1 - 2 * n[w - size]
        cost[1:][n[1 : w - size] == 0] = np.iinfo(np.int64).max
        at = int(cost.argmin())
        if n[w - size] and full <= cost[at]:
            at = w - size
        pieces = self.open[at].pop() if at else []
        n[at] -= at > 0
        pieces.append(piece)
        if at + size == w:
            return pieces
        n[at + size] += 1
        self.open[at + size].append(pieces)
        return None

    def rest(self) -> list[tuple[int, list]]:
        return [(f, p) for f in range(self.window - 1, 0, -1) for p in self.open[f]]


def merged(rest: list[tuple[int, list]], window: int, cut) -> Iterator[list]:
    """Sequences of the windows still open, fullest first: later pieces are cut to fill earlier windows."""
    stream = [piece for _, pieces in rest for piece in pieces]
    total, at, sequence, room = sum(p[1] for p in stream), 0, [], 0
    while at < len(stream) or sequence:
        if not room:
            if sequence:
                yield sequence
            if not total:
                return
            sequence, room = [], window if total >= window else 1 << (total.bit_length() - 1)
        piece = stream[at]
        if piece[1] > room:
            piece, stream[at] = cut(piece, room)
        else:
            at += 1
        sequence.append(piece)
        room -= piece[1]
        total -= piece[1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's token ids, for writing sequences."""
    path = tokenizer or default_tokenizer()

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), SumOfSquares(window)
        sequence = (TaskContext.get().partitionId() << 40) - 1
        rows: list[tuple] = []

        def cut(piece, size):
            doc, n, start, ids, total = piece
            return (doc, size, start, ids[:size], total), (doc, n - size, start + size, ids[size:], total)

        def emit(pieces):
            nonlocal sequence
            sequence += 1
            offset = 0
            for doc, n, start, ids, total in pieces:
                row = (doc, start, n, zlib.crc32(ids.tobytes()), total, sequence, offset)
                rows.append((*row, ids.tolist()) if with_ids else row)
                offset += n

        def flush():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                total = len(ids)
                whole = total - total % window
                for start in range(0, whole, window):
                    emit([(doc, window, start, ids[start : start + window], total)])
                if total > whole and (full := packer.place((doc, total - whole, whole, ids[whole:].copy(), total), total - whole)):
                    emit(full)
                if len(rows) >= 4096:
                    yield flush()
        for pieces in merged(packer.rest(), window, cut):
            emit(pieces)
        if rows:
            yield flush()

    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(partition, SCHEMA + (", ids array<long>" if with_ids else ""))
