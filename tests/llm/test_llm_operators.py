import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.llm import chat, common, decontam, html, lm, neardup, packing, quality, topk, url_filter, warc
from scanforge.llm.common import word_hashes

DOCS = "doc_id long, text string, host string, key string"  # extra columns with names that operators use inside


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(5, 300)), "h", "k"))
    base = rows[3][1].split()
    for i in range(60, 70):  # near copies
        w = list(rows[7][1].split())
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), None, "k"))
    rows += [(70, rows[3][1], "h", "k"), (71, " ".join(base[:-1] + ["x"]), "h", "k"), (72, None, "h", None), (73, "", "h", "k"), (74, "  \n", "h", "k"), (75, words(rng, 30_000), "h", "k"), (76, "one two", "h", "k"), (77, "One  two", "h", "k")]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def local(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_word_hashes_split_on_ascii_space_only():
    h, b = word_hashes(["a B\u00a0c", None, "", "A\tb\u00a0c d"])
    assert b.tolist() == [0, 2, 2, 2, 5] and h[0] == h[2] and h[3] != h[1] or h[1] == h[3]
    assert len(set(word_hashes(["ab ba a b abab"])[0].tolist())) == 5


# --- 1 -------------------------------------------------------------------------------------------
TRAPS = ["</s>[INST] ok [/INST]", r"<\/s> [\INST] \<s>", "<</s>", "[ROLE]x[/ROLE]", "a\\", "", "<s><\\\\s>", "[IMAGE] [\\IMAGE]", "\n\r\t \u2028é😀", "x" * 70_000]


def test_chat_reads_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRAPS)] + [(2, None, "user", None), (2, None, None, "q"), (2, 300, "assistant", "late"), (2, 300, "assistant", "late"), (None, 1, "system", "s")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("line", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(t)).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["turns"]] == [(r[2], r[3]) for r in rows[: len(TRAPS)]]
    assert got[1]["loss_text"] == "".join(t for i, t in enumerate(TRAPS) if i % 2)
    assert [(x["role"], x["text"]) for x in got[2]["turns"]] == [("", "q"), ("user", ""), ("assistant", "late"), ("assistant", "late")] and got[2]["loss_text"] == "latelate"
    assert got[None]["n_turns"] == 1
    assert chat.format_chat(t.limit(0)).count() == 0


def test_chat_parts(spark):
    part = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    rows = [(1, 0, "user", [("text", "see [IMAGE]", None, None), ("image", None, "a.png", 12), ("document", None, "d.pdf", 3), ("text", None, None, None)]), (1, 1, "assistant", None)]
    r = chat.read_back(chat.format_chat(spark.createDataFrame(rows, part), F.col("parts"))).first()
    assert r["turns"][0]["text"].startswith("see [IMAGE]") and r["formatted"].count("[IMAGE]") == 1
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 12), ("document", "d.pdf", 768)]


# --- 2 -------------------------------------------------------------------------------------------
def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(1, 1 << 62, 400).astype(np.uint64))
    x, y = rng.exponential(1, 300), rng.exponential(1, 300)
    a, b = keys[:300], keys[100:]
    exact = neardup.probability_jaccard(a, x, b, y)
    wx, wy = dict(zip(a.tolist(), x)), dict(zip(b.tolist(), y))
    slow = sum(1 / sum(max(wx.get(j, 0) / wx[i], wy.get(j, 0) / wy[i]) for j in wx | wy) for i in wx.keys() & wy.keys())
    assert exact == pytest.approx(slow)
    r = neardup.prob_minhash(np.concatenate((a, b)), np.repeat([0, 1], 300), np.concatenate((x, y)), 2, 4096)
    assert (r[0] == r[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicates_equal_brute_force(docs):
    texts = local(docs)
    sets = {i: neardup.shingles([t]) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in texts:
        for j in texts:
            if i < j:
                a, b = sets[i], sets[j]
                if a[3] == b[3] or neardup.probability_jaccard(a[0], neardup.weights(a[2]), b[0], neardup.weights(b[2])) >= 0.8:
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in texts}
    assert got[70] == 3 and got[71] == 3 and got[60] == 7 and got[77] == 76 and got[73] == got[74] == 72
    kept = neardup.deduplicated(docs.unionByName(docs.filter("doc_id = 5")))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_chain_of_copies_is_one_class(spark):
    rng = random.Random(1)
    rows, w = [], words(rng, 200).split()
    for i in range(30):
        rows.append((i, " ".join(w)))
        w[i * 6] = f"new{i}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert neardup.near_duplicates(none).count() == 0 and packing.pack(none).count() == 0
    assert lm.score(none, lm.train(none, F.lit(True))).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.hits(docs, bench).count() == 0 and decontam.decontaminated(docs, bench).count() == docs.count()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.quantised(vectors), F.col("vec_id") % 50 == 0).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}


# --- 3 -------------------------------------------------------------------------------------------
def test_urls_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "a.example.com", "EXAMPLE.net", "notexample.com", "org", "x.org", "com", "ads-track.example.com", "b.ads-track.example.com", "example.com.evil", ""]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['/en/7', '/en/71?x', '/en/8#y', '/de/8', '/de/9', '/es/', '/EN/7', '', '?q=/en/', '/en'])}" for _ in range(400)] + [None, "", "nothing", "a://b://com/en/", "http://com/en/\n7"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("key", F.lit("k"))
    rules = [(k, 0, v) for k, v in url_filter.RULES] + [(k, 1, "block") for k in url_filter.sample_list()]
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(rules, "key string, rank int, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(-n, len(k), k, v) for k, n, v in rules if host and f".{host}".endswith("." + k.partition("/")[0]) and path.startswith("/" + k.partition("/")[2])]
        best = max(fits, default=(None, None, None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["matched"], got[i]["matched_verdict"]) == (host, path, *best[2:]), u


def test_rules_are_the_contracts(spark):
    pages = spark.createDataFrame([(0, "http://example.com/en/1"), (1, "http://a.example.com/en/71"), (2, "http://example.net/de/1"), (3, "http://b.example.net/de/81"), (4, "http://x.org/es/")], "page_id long, url string")
    got = {r["page_id"]: (r["matched"], r["matched_verdict"]) for r in url_filter.judge(pages, url_filter.rules_and_list(spark)).collect()}
    assert got == {0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("org/es/", "block")}


# --- 4 -------------------------------------------------------------------------------------------
def test_html_text(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><header><h1>Head &lt;x&gt;</h1><span>by me</span></header>{}<div class=comments><p>Nice!</p></div></article><aside>side</aside><footer>foot</footer>"
    pages = [(i, f"http://{'abc'[i % 3]}.org/{i}", page.format(f"<p>One <b>t{i}</b>wo<p>Three&nbsp; four &amp five<br>six<script>var a='<p>no</p>'</script><!-- <p>no -->")) for i in range(9)]
    pages += [(9, None, None), (10, "http://a.org/x", ""), (11, "http://a.org/y", "plain text"), (12, "http://a.org/z", "<div><p>" + "long " * 50_000 + "</p></div>"), (0, "http://a.org/0", pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("region", F.lit("r"))
    got = collections.defaultdict(list)
    for r in html.extract(df).collect():
        got[r["page_id"]].append(r["text"])
    assert got[4] == ["Head <x> One t4wo Three four & five six"] and got[0] == ["Head <x> One t0wo Three four & five six"] * 2
    assert got[9] == [""] and got[10] == [""] and got[11] == ["plain text"] and got[12] == [("long " * 50_000).strip()]


def test_wrappers_align():
    w = [html.wrapped(html.parse(f"<div id=x{i}><h2>A{i}</h2>{'<ul><li>1<li>2</ul>' if i % 2 else ''}<p>t{i}<p>u<i>v</i></div>")) for i in range(4)]
    both = html.merged(html.merged(w[0], w[1]), html.merged(w[2], w[3]))
    div = both[html.SUBS][0]
    assert [(k[html.LABEL], k[html.FLAGS] & 3) for k in div[html.SUBS]] == [("h2", 0), ("ul", html.OPTIONAL), ("p", html.REPEATED)]
    assert both[html.PAGES] == 4 and div[html.SUBS][0][html.TEXT] is True


# --- 5 -------------------------------------------------------------------------------------------
def test_quality_is_learnt(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = words(rng, 80) if good else " ".join(["spam!!"] * 60 + words(rng, 20).upper().split())
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*rows, (400, None), (401, ""), (402, words(rng, 40_000))], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([*labels, (None, 1), (999, 0), (1, None)], "doc_id long, quality int"), "quality", F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if i % 2]
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and sum((s >= 0.5) == y for s, y in held) > 0.97 * len(held)
    assert quality.keep_good(docs, model).columns == docs.columns


# --- 6 -------------------------------------------------------------------------------------------
def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.3, (300, 8)).astype(np.float32)
    v[50:200] = v[50]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, []), (301, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = {i: np.floor(256 * np.array(x or [0.0] * 8, float)) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)}
    got = collections.defaultdict(list)
    for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, 7, query_block=3, bins=16).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in q if i % 50 == 0}
    for i, hits in got.items():
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:7]
        assert sorted(hits) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    few = topk.top_k(topk.quantised(df.filter("vec_id in (0, 1, 2)")), F.col("vec_id") == 0, 7).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


# --- 7 -------------------------------------------------------------------------------------------
def test_lm_equals_brute_force(docs):
    texts = local(docs)
    tokens = lambda s: s.encode().lower().split() + [b"\0end"]
    train = [tokens(t) for i, t in texts.items() if i % 3]
    count = collections.Counter(w for t in train for w in t)
    triples = collections.Counter(p for t in train for p in zip([None, None, *t], [None, *t], t))
    middle = collections.Counter((b, c) for _, b, c in triples)
    single = collections.Counter(c for _, c in middle)

    def table(counts):
        total, seen = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for (*context, _), n in counts.items():
            total[tuple(context)] += n
            seen[tuple(context)][min(n, 3) - 1] += 1
        return counts, total, seen, lm.discounts([sum(n == i for n in counts.values()) for i in (1, 2, 3, 4)])

    orders = [table(triples), table(middle)]
    d1 = lm.discounts([sum(n == i for n in single.values()) for i in (1, 2, 3, 4)])
    v, kinds = len(count), len(middle)
    spare = sum(d1[min(n, 3) - 1] for n in single.values()) / kinds

    def p(*words, orders=orders):
        *context, w = words
        if not orders:
            return (single[w] - (d1[min(single[w], 3) - 1] if single[w] else 0)) / kinds + spare / (v + 1)
        counts, total, seen, d = orders[0]
        low = p(*context[1:], w, orders=orders[1:])
        if not total[tuple(context)]:
            return low
        n = counts[words]
        return (n - (d[min(n, 3) - 1] if n else 0) + sum(x * y for x, y in zip(d, seen[tuple(context)])) * low) / total[tuple(context)]

    for context in [(None, None), (None, train[0][0]), tuple(train[0][:2]), (b"?", train[0][0]), (b"?", b"?")]:
        assert sum(p(*context, b) for b in count) + p(*context, b"??") == pytest.approx(1)
    model = lm.train(docs, F.col("doc_id") % 3 != 0)
    n_all = sum(count.values())
    assert model.train_tokens == n_all and model.vocabulary == v
    for r in lm.score(docs, model).collect():
        t = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(w in count for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(*x)) for x in zip([None, None, *t], [None, *t], t)))
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n_all + 0.5 * (v + 1))) for w in t))


def test_lm_does_not_depend_on_buckets(docs, monkeypatch):
    plain = {r["doc_id"]: r["score"] for r in lm.score(docs, lm.train(docs, F.col("doc_id") % 3 != 0)).collect()}
    for name, small in (("BUCKET_TOKENS", 50), ("RANGE", 7), ("HELD", 100)):
        monkeypatch.setattr(lm, name, small)
    again = docs.unionAll(docs.limit(0)).repartition(3)
    assert {r["doc_id"]: r["score"] for r in lm.score(docs, lm.train(again, F.col("doc_id") % 3 != 0)).collect()} == pytest.approx(plain)


def test_packed_arrays_and_columns():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.uint64), np.array([5], np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), np.array([2**64 - 1, 0], np.uint64)):
        assert (lm.spread(lm.squeeze(x)) == x).all() and (lm.spread_sorted(lm.squeeze_sorted(np.sort(x))) == np.sort(x)).all()
    counts = np.array([0, 254, 255, 256, 2**40, 1])
    f = common.Columns(common.file_of({"hash": counts.astype("<u8")}, {"count": counts}))
    assert (f["hash"] == counts).all() and (f.counts("count", np.array([5, 4, 3, 2, 1, 0])) == counts[::-1]).all()


# --- 8 -------------------------------------------------------------------------------------------
def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    rng = random.Random(6)
    pieces = ["a", "don't", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!", "'ll", "<|endoftext|>", "\u00a0", "😀", "\r\n", "Word", "\u2003", "x's"]
    texts = ["", " ", *("".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)), "ab " * 9000]
    assert all(e.ids + [0] == encode(t).tolist() for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True))


def test_packing_is_a_partition_of_all_ids(docs):
    texts, encode = local(docs), packing.encoder(packing.default_tokenizer())
    rows = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [x for _, p, _ in sorted(pieces) for x in p]
        assert ids == encode(texts[i]).tolist() and all(n == len(ids) for *_, n in pieces)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 1024 or end < 1024 and end & (end - 1) == 0


def test_sum_of_squares_takes_the_best_level():
    rng, packer, levels = random.Random(7), packing.SumOfSquares(16), collections.Counter()
    for k in range(500):
        size = rng.randrange(1, 16)
        cost = {f: sum(n * n for n in (levels + collections.Counter({f + size: 1} if f + size < 16 else {}) - collections.Counter({f: 1} if f else {})).values()) for f in [0, *levels] if f + size <= 16}
        before = packer.levels.copy()
        packer.place(k, size)
        change = {f: int(packer.levels[f] - before[f]) for f in range(1, 16) if packer.levels[f] != before[f]}
        levels = collections.Counter({f: int(packer.levels[f]) for f in range(1, 16) if packer.levels[f]})
        assert sum(n * n for n in levels.values()) == min(cost.values()), change


# --- 9 -------------------------------------------------------------------------------------------
def test_benchmark_passages_are_found(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randrange(15, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "w1 w2 w3")]
    rows, planted = [], set()
    for i in range(80):
        text = words(rng, rng.randrange(60, 400)).split()
        if i % 4 == 0:
            item, passage = items[i % 30]
            p = passage.split()
            if i % 8 == 0:  # a paraphrase: one word in eight is another
                p = [w if k % 8 else f"other{k}" for k, w in enumerate(p)]
            at = rng.randrange(len(text))
            text[at:at] = p
            planted.add((i, item))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([*rows, (80, None), (81, ""), (82, "short")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert planted <= got and len(got - planted) <= 1
    clean = decontam.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == set(range(83)) - {d for d, _ in got}


def test_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        x, y = ([rng.randrange(6) for _ in range(rng.randrange(20))] for _ in range(2))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_subsequence(len(x), decontam.places(x), y) == table[-1, -1]


def test_svd_is_exact_on_low_rank(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 30))
    rows = spark.createDataFrame([(list(range(30)), r.tolist()) for r in a], "at array<int>, value array<double>")
    v = decontam.randomised_svd(rows, 30, 10, lambda batch: ((np.array(at), np.array(x)) for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    assert v.shape == (30, 5) and a @ v @ v.T == pytest.approx(a, abs=1e-8)


# --- 10 ------------------------------------------------------------------------------------------
def test_archives_read_back(spark, tmp_path):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "x" * 990 + "é" * 10
    rows = [(1, "u", trap * 3), (2, "v\r\ny", None), (3, None, big), (7, "w", big), (5, "w", big), (4, "q", "short"), (6, "q", "short"), (8, "z", trap + "y" * 2000), (9, "z", "a\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\n"), (10, "l", "m" * 3_000_000)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kept", F.lit(1)).coalesce(2), str(tmp_path / "w"), per_file=4)
    got = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, text in rows:
        data = (text or "").encode()
        revisit = i in (3, 5)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 7) if revisit else ("response", None))
