"""MinHash near-dedup (operator 2): ProbMinHash sketches of weighted word shingles, bands, verification.

Every shingle (five words, or a shorter text's all words) of weight 1 + ln(count) is a Poisson
process of that rate: its arrivals, from hashes of the shingle, each fall on one of the registers,
which keep their earliest arrival's shingle. A text's shingles stop as soon as their next arrival
comes after its latest register, all at once in array arithmetic. Two texts share a register with
the probability Jaccard similarity J_P of their weighted shingles, so equal bands of registers
propose pairs, and the exact J_P of the two whole texts decides.

Scale. Equal texts are collapsed first by a digest of their words (a text is named by it), and only
buckets (equal bands) of several texts are kept. A bucket is never expanded into pairs:

1. Its members meet its pivot, the member with most neighbours over all its buckets. A text has at
   most as many pivots as bands, and all these pairs are verified. A text points to the greatest
   pivot that it is linked with; large groups of copies settle on their original here.
2. Buckets whose other members then point to several classes are finished exactly: all pairs of their
   texts of different classes that can have the J_P asked for share one of their rarest shingles.
   Such pairs are packed by two blocks of texts, verified where these blocks meet, and leave a
   spanning forest of links.

So no pair that a bucket proposes is left untested, unless both are in one class already. Links join
classes by least labels with pointer jumping, over what is not yet in one class. The number of steps
does not depend on the sizes of groups. Tables for which a hot bucket or key is joined are stored, so
that Spark may broadcast the small side or split the hot partition; counts are partly aggregated.

A row per document: class_id is the least doc_id of its class. Words are separated by space and
0x09-0x0D, A-Z are lower-cased. Texts without words (null, empty) are copies of each other. Texts are
compared whole. Rows that share a doc_id are in one class; null ids come back with a null class.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, mixed, pieces, seeded, slices, small, stored, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SLOTS, BLOCK_TEXTS, LIST = 1 << 18, 512, 2048
#: Pivots whose shingles a task keeps at hand, and pairs that it packs together.
PIVOTS_HELD, PAIRS_HELD = 256, 1 << 21
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles' hashes, their texts' numbers and counts, sorted by text and hash; digests of the texts' words."""
    hashes, bounds = word_hashes(texts)
    digests = [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    n = np.diff(bounds)
    document = np.repeat(np.arange(len(n)), n)
    rolled = hashes.copy()
    for k in range(1, words):
        rolled[:-k] = rolled[:-k] * _PRIME + hashes[k:] if len(rolled) > k else rolled[:-k]
    whole = np.arange(len(hashes)) + words <= bounds[1:][document]
    keys, owners = mixed(rolled[whole]), document[whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        extra = np.array([int.from_bytes(digests[i][:8], "little") for i in short], np.uint64)
        keys, owners = np.concatenate((keys, extra)), np.concatenate((owners, short))
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])))) if len(keys) else np.empty(0, np.int64)
    return keys[first], owners[first], np.diff(np.append(first, len(keys))), digests


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def prob_minhash(keys: np.ndarray, owners: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The registers of all texts: per register the element whose arrival is the earliest."""
    earliest = np.full(texts * registers, np.inf)
    element = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    time = np.zeros(len(keys))
    arrival = 0
    while len(keys):
        u = (seeded(keys, 2 * arrival) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        time = time - np.log(u) / weight
        arrived = time < latest[owners]
        keys, owners, weight, time = keys[arrived], owners[arrived], weight[arrived], time[arrived]
        at = owners * registers + (seeded(keys, 2 * arrival + 1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        element[at[won]] = keys[won]
        present = np.unique(owners)
        latest[present] = earliest.reshape(texts, registers)[present].max(1)
        arrival += 1
    return element.reshape(texts, registers)


def bands(texts: list[str | None], n_bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Band hashes (one row per text), which texts have words, and digests."""
    keys, owners, counts, digests = shingles(texts, words)
    registers = prob_minhash(keys, owners, weights(counts), len(texts), n_bands * rows).reshape(len(texts), n_bands, rows)
    h = np.broadcast_to(np.arange(n_bands, dtype=np.uint64), registers.shape[:2]).copy()
    for r in range(rows):
        h = mixed(h * _PRIME + registers[:, :, r])
    there = np.zeros(len(texts), bool)
    there[owners] = True
    return h, there, digests


def probability_jaccard(x_keys: np.ndarray, x: np.ndarray, y_keys: np.ndarray, y: np.ndarray) -> float:
    """The exact J_P of two weighted sets with sorted keys: sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    _, at_x, at_y = np.intersect1d(x_keys, y_keys, assume_unique=True, return_indices=True)
    if not len(at_x):
        return 0.0
    a, b = x[at_x], y[at_y]
    ratio = b / a
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    only_x, only_y = x.sum() - a.sum(), y.sum() - b.sum()
    upto = np.cumsum(a)
    beyond = b.sum() - np.cumsum(b)
    # Elements with a ratio of at most that of i count by x, the others by y.
    return float(np.sum(1 / ((upto + only_x) / a + (beyond + only_y) / b)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a digest of the words) and bands (null without words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                h, there, digests = bands(texts)
                lists = pa.array([r if t else None for r, t in zip(h.view(np.int64), there, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), lists], ["doc_id", "key", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sketch, "doc_id long, key binary, bands array<long>")


def digests_of(texts: list[str | None]) -> list[bytes]:
    hashes, bounds = word_hashes(texts)
    return [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text, a row for each of nodes (node, doc_id): the text is read from docs and told by its digest."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                same = pa.array([x == y for x, y in zip(digests_of(texts), part.column(0).to_pylist(), strict=True)], pa.bool_())
                yield part.filter(same)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.join(small(nodes, 40), "doc_id").select("node", "text").mapInArrow(told, "node binary, text string").groupBy("node").agg(F.first("text").alias("text"))


def neighbours(distinct: DataFrame, tables: Tables) -> DataFrame:
    """For each node that shares a bucket: node, doc_id and met, an array (one entry per bucket) of the bucket and its pivot.

    The pivot of a bucket is the member whose buckets hold most texts together.
    """
    rows = distinct.filter("bands IS NOT NULL").select("node", "doc_id", F.explode("bands").alias("bucket"))
    sizes = tables.put(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    nodes = tables.put(rows.join(sizes, "bucket").groupBy("node", "doc_id").agg(F.sum("size").alias("degree"), F.collect_set("bucket").alias("buckets")), "nodes")
    members = nodes.select("node", "doc_id", "degree", F.explode("buckets").alias("bucket"))
    pivots = tables.put(members.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("pivot")), "pivots")
    return members.join(pivots, "bucket").groupBy("node", "doc_id").agg(F.collect_list(F.struct("bucket", "pivot")).alias("met"))


def linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, a_degree, b) of nodes whose whole texts have a J_P of at least `least`."""
    both = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}  # of pivots, which many pairs share
        for batch in batches:
            keep = []
            for start, stop, others in pieces(batch.column("text_b")):
                names = batch.column("a").slice(start, stop - start).to_pylist()
                for k, (a, y) in enumerate(zip(names, others, strict=True), start):
                    if a not in known:
                        if len(known) >= PIVOTS_HELD:
                            known.clear()
                        known[a] = weighted(batch.column("text_a")[k].as_py())
                    keep.append(probability_jaccard(*known[a], *weighted(y)) >= least)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "a_degree", "b"])

    return both.select("a", "a_degree", "b", "text_a", "text_b").mapInArrow(verify, "a binary, a_degree long, b binary")


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    keys, _, counts, _ = shingles([text])
    return keys, weights(counts)


def pointed(links: DataFrame) -> DataFrame:
    """node and label: of the pivots that a node is linked with the greatest, or that one's own.

    Pivots are greater than what points to them, so there are no rings; equal labels mean one class.
    """
    up = links.groupBy("b").agg(F.max(F.struct("a_degree", "a")).alias("m")).select(F.col("b").alias("node"), F.col("m.a").alias("up"))
    return up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up", "left").select("node", F.coalesce("far", "up").alias("label"))


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node and label (the least node that it is connected with) for edges (a, b): least labels with pointer jumping."""
    both = tables.put(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = tables.put(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    changed = not labels.isEmpty()
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.join(near, "node").join(hop, "label", "left").select("node", F.least("near", "far", "label").alias("new"), "label")
        step = tables.put(step, "labels")
        changed = not step.filter("new <> label").isEmpty()
        labels = step.select("node", F.col("new").alias("label"))
    return labels


def still_open(met: DataFrame, labels: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """node, label, block and text of the nodes with pairs that no pivot has settled.

    In a bucket all pairs with its pivot are tested, so it is open if its other members have several
    labels. Blocks are pieces of families (nodes with the same greatest pivot) of about BLOCK_TEXTS.
    """
    family = F.array_max(F.transform("met", lambda m: m["pivot"]))["node"]
    named = met.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), family.alias("family"), F.explode("met").alias("m"))
    named = tables.put(named.filter("node <> m.pivot.node").select("node", "label", "family", F.col("m.bucket").alias("bucket")), "named")
    buckets = tables.put(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket"), "open-buckets")
    nodes = tables.put(named.join(buckets, "bucket", "left_semi").select("node", "label", "family").distinct(), "open-nodes")
    large = nodes.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_TEXTS)
    pieces = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK_TEXTS)
    block = F.xxhash64("family", F.pmod(F.xxhash64("node"), pieces))
    return tables.put(nodes.join(large, "family", "left").select("node", "label", block.alias("block")).join(texts, "node"), "open")


def rarest(nodes: DataFrame, least: float) -> DataFrame:
    """node, label, block, key, before: the rarest shingles of nodes, and the share of weight of still rarer ones.

    Shingles are in one order for all texts, by counts of their hashes modulo SLOTS. With shares p and q
    of the two texts' weights, J_P is at most the sum of min(p, q), and so at most 1 less what comes
    before the first common shingle; shingles with more than 1 - least before them need not be kept.
    """

    def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, texts in pieces(batch.column(0)):
                n += np.bincount((shingles(texts)[0] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    counted = nodes.select("text").mapInArrow(count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()  # SLOTS rows at most
    common = np.ones(SLOTS, np.int64)
    common[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    held = nodes.sparkSession.sparkContext.broadcast(common)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(3)):
                keys, owners, counts, _ = shingles(texts)
                order = np.lexsort((keys, held.value[(keys % np.uint64(SLOTS)).astype(np.int64)], owners))
                keys, owners, weight = keys[order], owners[order], weights(counts)[order]
                share = weight / np.bincount(owners, weight, b - a)[owners]
                before = np.cumsum(share) - share
                before = np.maximum(before - before[np.searchsorted(owners, owners)], 0)
                kept = before <= 1 - least + 1e-9
                at = pa.array(owners[kept] + a)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(3)], pa.array(keys[kept].view(np.int64)), pa.array(before[kept])], ["node", "label", "block", "key", "before"])

    return nodes.select("node", "label", "block", "text").mapInArrow(first, "node binary, label binary, block long, key long, before double")


def promising(rare: DataFrame, least: float, tables: Tables) -> DataFrame:
    """Pairs of nodes of different labels that share a rare shingle and can have the J_P asked for, packed by pairs of blocks.

    With x and y before a common shingle, J_P is at most (1 - x)(1 - y) / (1 - xy); for a pair with the
    J_P asked for, that holds at its first common one. A list of nodes with the same shingle is cut in
    pieces of about LIST, which meet two by two, so no task holds more. Rows are (i, j, nodes, pairs): two
    blocks, the nodes, and int32 places of the pairs among them.
    """
    lists = tables.put(rare.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", F.ceil(F.col("n") / LIST).cast("int").alias("pieces")), "lists")
    cut = rare.join(lists, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "label", "block", "before")
    cut = cut.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        nodes, blocks, codes, held = [], [], [], 0
        labels: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            nonlocal held
            pair = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
            a, b = pair >> 32, pair & 0xFFFFFFFF
            block = np.array(blocks, np.int64)
            i, j = block[a], block[b]
            a, b, i, j = np.where(i <= j, a, b), np.where(i <= j, b, a), np.minimum(i, j), np.maximum(i, j)
            order = np.lexsort((j, i))
            a, b, i, j = a[order], b[order], i[order], j[order]
            first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])))) if len(i) else np.empty(0, np.int64)
            names, packed = [], []
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(i)], strict=False):
                own, back = np.unique(np.concatenate((a[s:e], b[s:e])), return_inverse=True)
                names.append([nodes[x] for x in own.tolist()])
                packed.append(back.astype("<i4").tobytes())
            out = pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(j[first]), pa.array(names, pa.list_(pa.binary())), pa.array(packed, pa.binary())], ["i", "j", "nodes", "pairs"])
            place.clear(), nodes.clear(), blocks.clear(), codes.clear()
            held = 0
            return out

        def pairs(ids: np.ndarray, of: np.ndarray, before: np.ndarray, own: np.ndarray) -> None:
            nonlocal held
            two = own[0] != own[-1] or (own != own[0]).any()
            left = np.flatnonzero(own == own.min()) if two else np.arange(len(ids))
            for k in range(0, len(left), 256):
                x = left[k : k + 256][:, None]
                y = np.flatnonzero(own != own.min())[None, :] if two else np.arange(len(ids))[None, :]
                bound = (1 - before[x]) * (1 - before[y]) >= least * (1 - before[x] * before[y]) - 1e-9
                at_x, at_y = np.nonzero(bound & (of[x] != of[y]) & (True if two else x < y))
                if len(at_x):
                    m, n = ids[x[at_x, 0]], ids[y[0, at_y]]
                    codes.append(np.unique((np.minimum(m, n) << 32) | np.maximum(m, n)))
                    held += len(codes[-1])

        rest: list[pa.RecordBatch] = []

        def process(table: pa.Table) -> None:
            key, p, q = (table.column(c).to_numpy() for c in ("key", "p", "q"))
            own, before = table.column("own").to_numpy(), table.column("before").to_numpy()
            ids, of = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            for k, (node, label, block) in enumerate(zip(table.column("node").to_pylist(), table.column("label").to_pylist(), table.column("block").to_pylist(), strict=True)):
                if node not in place:
                    place[node] = len(nodes)
                    nodes.append(node), blocks.append(block)
                ids[k], of[k] = place[node], labels.setdefault(label, len(labels))
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
                # A cell of two pieces of which one is empty has no pairs.
                if e - s > 1 and (p[s] == q[s] or (own[s:e] != own[s]).any()):
                    pairs(ids[s:e], of[s:e], before[s:e], own[s:e])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, p, q = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "p", "q"))
            # The last cell may go on in the next batch.
            last = int(np.flatnonzero((key != key[-1]) | (p != p[-1]) | (q != q[-1]))[-1]) + 1 if ((key != key[-1]) | (p != p[-1]) | (q != q[-1])).any() else 0
            if rest and (last or (rest[-1].column(0)[0].as_py(), rest[-1].column(1)[0].as_py(), rest[-1].column(2)[0].as_py()) != (key[0], p[0], q[0])):
                process(pa.Table.from_batches([*rest, batch.slice(0, last)]))
                rest = []
            elif last:
                process(pa.Table.from_batches([batch.slice(0, last)]))
            rest.append(batch.slice(last))
            if held > PAIRS_HELD:
                yield flush()
        if rest:
            process(pa.Table.from_batches(rest))
        yield flush()

    return tables.put(cut.mapInArrow(meet, "i long, j long, nodes array<binary>, pairs binary"), "promising")


def missed_links(nodes: DataFrame, least: float, tables: Tables) -> DataFrame:
    """Links (a, b) that join all nodes of different labels with a J_P of at least `least`: of each two blocks a spanning forest."""
    packed = promising(tables.put(rarest(nodes, least), "rare"), least, tables)
    needed = packed.select("i", "j", F.explode("nodes").alias("node")).distinct()
    needed = needed.join(nodes.select("node", "label", "text"), "node").withColumnsRenamed({"i": "p", "j": "q"})

    def verify(packed, texts):
        own, sets, up = texts["text"].tolist(), [], {}
        for a, b in slices(own):
            keys, owners, counts, _ = shingles(own[a:b])
            at, weight = np.searchsorted(owners, np.arange(b - a + 1)), weights(counts)
            sets += [(keys[at[k] : at[k + 1]], weight[at[k] : at[k + 1]]) for k in range(b - a)]
        place = {n: k for k, n in enumerate(texts["node"].tolist())}
        labels, links, tested = texts["label"].tolist(), [], set()

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for nodes, pairs in zip(packed["nodes"].tolist(), packed["pairs"].tolist(), strict=True):
            at = np.array([place[n] for n in nodes])
            for x, y in at[np.frombuffer(pairs, "<i4").reshape(2, -1)].T.tolist():
                one, two = root(labels[x]), root(labels[y])
                if one != two and (x, y) not in tested:
                    tested.add((x, y))
                    if probability_jaccard(*sets[x], *sets[y]) >= least:
                        up[one] = two
                        links.append((labels[x], labels[y]))
        return pd.DataFrame(links, columns=["a", "b"])

    return tables.put(packed.groupBy("i", "j").cogroup(needed.groupBy("p", "q")).applyInPandas(verify, "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id for each row of docs."""
    tables = Tables(docs.sparkSession)
    sketch = stored(sketches(docs), "sketches")
    first = F.min(F.struct("doc_id", "bands"))
    distinct = tables.put(sketch.filter("doc_id IS NOT NULL").groupBy(F.col("key").alias("node")).agg(first.alias("m")).select("node", "m.doc_id", "m.bands"), "distinct")
    met = tables.put(neighbours(distinct, tables), "met")
    texts = tables.put(texts_of(docs, met.select("node", "doc_id")), "texts")
    pairs = met.select(F.explode(F.array_distinct(F.transform("met", lambda m: m["pivot"]))).alias("pivot"), F.col("node").alias("b"))
    pairs = pairs.select(F.col("pivot.node").alias("a"), F.col("pivot.degree").alias("a_degree"), "b").filter("a <> b")
    links = tables.put(linked(pairs, texts, least), "links")
    labels = tables.put(pointed(links), "labels")
    more = missed_links(still_open(met, labels, texts, tables), least, tables)
    # Rows that share an id are one document.
    several = sketch.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("doc_id", "a")
    same = sketch.join(several, "doc_id").select("a", F.col("key").alias("b"))
    label_of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    edges = links.select("a", "b").unionByName(same).join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    edges = edges.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).unionByName(more).filter("a <> b")
    joined = components(edges, tables).select(F.col("node").alias("label"), F.col("label").alias("root"))
    # Every text of a class of several, with its class; other texts are classes of their own.
    ends = labels.select("node", "label").unionByName(labels.select("label", F.col("label").alias("node"))).unionByName(joined.select("label", F.col("label").alias("node")))
    roots = ends.distinct().join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    roots = tables.put(roots.join(distinct.select("node", "doc_id"), "node"), "roots")
    least_id = roots.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = roots.join(least_id, "root").groupBy("node").agg(F.min("class_id").alias("class_id"))
    of_key = stored(distinct.select("node", "doc_id").join(classes, "node", "left").select(F.col("node").alias("key"), F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    tables.drop()
    return sketch.select("doc_id", "key").join(of_key, "key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that are the first of their class; one row for each such id. Rows without id stay."""
    groups = stored(near_duplicates(docs, least), "groups")
    go = groups.filter("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(small(go, 16), "doc_id", "left_anti")
    again = groups.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept.select(docs.columns)
    once, more = kept.join(again, "doc_id", "left_anti"), kept.join(again, "doc_id", "left_semi")
    return once.select(docs.columns).unionByName(more.dropDuplicates(["doc_id"]).select(docs.columns))
