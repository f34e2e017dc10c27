"""Cases that the operators once left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.llm import common, decontam, neardup, packing, quality, topk, url_filter, warc


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 2 -------------------------------------------------------------------------------------------
def test_near_copies_inside_a_family_of_likenesses(spark):
    rng = random.Random(21)
    shared, rows, twin = words(rng, 86), [], {}
    for i in range(0, 400, 2):  # J_P about 0.69 between the pairs, 0.87 inside
        own = words(rng, 18, 10**6).split()
        rows += [(i, f"{shared} {' '.join(own)}"), (i + 1, f"{shared} {' '.join([*own[:11], *words(rng, 7, 10**6).split()])}")]
        twin |= {i: i, i + 1: i}
    k, w = zip(*((x[0], neardup.weights(x[2])) for x in (neardup.shingles([t]) for _, t in rows[:4])), strict=True)
    assert neardup.probability_jaccard(k[0], w[0], k[1], w[1]) > 0.8 > neardup.probability_jaccard(k[0], w[0], k[2], w[2])
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == twin


# --- 9 -------------------------------------------------------------------------------------------
def test_capitals_with_accents_are_found(spark):
    rng = random.Random(20)
    item = " ".join(f"{'éñóü'[i % 4]}w{i}" if i % 2 else f"plain{i}" for i in range(30))
    docs = [(0, f"{words(rng, 60)} {item.upper()} {words(rng, 60)}"), (1, words(rng, 150)), (2, None), (3, item.replace("plain", "PLAIN"))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, words(rng, 30))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontam.hits(df, bench).collect()}
    assert got == {(0, 7): 1.0, (3, 7): 1.0}
    assert {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()} == {1, 2}


def test_short_items_and_paraphrases_are_found(spark):
    rng = random.Random(22)
    items = [(n, " ".join(f"item{n}x{k}" for k in range(n))) for n in range(1, 16)]
    items += [(100 + i, words(rng, 30)) for i in range(40)]
    rows, planted = [], set()
    for item, text in items:
        p = text.split()
        if item >= 100:  # 35 % of the words are others
            for k in rng.sample(range(len(p)), int(0.35 * len(p))):
                p[k] = f"other{k}"
        w = words(rng, 200, 10**6).split()
        at = rng.randrange(len(w))
        w[at:at] = p
        rows.append((item, " ".join(w)))
        planted.add((item, item))
    rows += [(1000 + i, words(rng, 200)) for i in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # Below LCS_SURE half of the rarest words must be there, which replaced ones may miss.
    assert {x for x in planted if x[0] < 100} <= got and got <= planted and len(got) >= 15 + 34


def longest_common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def test_hits_equal_brute_force(spark):
    rng = random.Random(23)
    items = [(i, words(rng, rng.randrange(9, 60), 1500)) for i in range(30)]
    rows = []
    for i in range(90):
        w = words(rng, rng.randrange(120), 1500).split()
        if i % 3 == 0:
            p = items[i % 30][1].split()
            for k in rng.sample(range(len(p)), len(p) * (i % 5) // 20):
                p[k] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, " ".join(w)))
    rows += rows[:6] + [(500, None), (501, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cosine", F.lit("x")), spark.createDataFrame(items, "item_id long, text string").withColumn("answer", F.lit("ignored"))
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontam.hits(docs, bench).collect()}
    for doc, text in dict(rows).items():
        for item, passage in items:
            p, t = passage.split(), (text or "").split()
            # Whatever reaches the sure share over the whole text in one stretch must be found.
            best = max((longest_common(p, t[s : s + len(p) + 4]) / len(p) for s in range(0, max(1, len(t) - len(p)), 2)), default=0)
            if best >= decontam.LCS_SURE:
                assert got[doc, item] >= best - 1e-9
            elif longest_common(p, t) / len(p) < decontam.LCS_LEAST:
                assert (doc, item) not in got
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in got})


def test_hits_do_not_depend_on_blocks(spark):
    rng = random.Random(24)
    items = [(i, words(rng, 40, 3000)) for i in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"{words(rng, 50)} {items[i][1]} {words(rng, 50)}" for i in range(24)] + [words(rng, 20_000)]
    one, many = decontam.build(bench), decontam.build(bench, block=5)
    assert len(one.blocks) == 1 < len(many.blocks) and one.basis.shape[1] == 12
    found = [sorted(decontam.matches(x, texts)) for x in (one, many)]
    assert np.allclose(*found) and {(t, i) for t, i, *_ in found[0]} == {(i, i) for i in range(24)}


# --- 10 ------------------------------------------------------------------------------------------
def test_archives_hold_large_ids_and_false_headers(spark, tmp_path):
    fake = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\nx" for n in [10**6] * 3000 + [1, 5])
    big = 9007199254740993
    rows = [(big, "u", "p" * 2000), (big - 2, "u", "p" * 2000), (None, None, "p" * 2000), (3, "a\r\nb", fake), (4, "u", fake), (5, "u", None), (6, "u", "WARC/1.1\r\n"), (7, "u", "short"), (8, "u", "short")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kept", F.lit(1)).coalesce(2), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got[big]["record_type"] == "response" and got[big - 2]["refers_to"] == big and got[3]["refers_to"] == 4
    assert got[4]["payload_bytes"] == len(fake) and got[5]["payload_bytes"] == 0 and got[7]["record_type"] == got[8]["record_type"] == "response"


def test_empty_tables_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
    assert url_filter.judge(pages, url_filter.rules_and_list(spark)).count() == 0


# --- 5 -------------------------------------------------------------------------------------------
def naive_fit(x, y, trees, depth, bins):
    """The same boosting by loops over rows, features and cuts."""
    base = np.log(y.mean() / (1 - y.mean()))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    margin, model = np.full(len(y), base), []

    def grow(rows, level, g, h):
        if level == depth:
            return quality.RATE * g[rows].sum() / (h[rows].sum() + quality.SMOOTH)
        best = (1e-6, None)
        for j in range(x.shape[1]):
            for c in cuts[j]:
                left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                if h[left].sum() < 1 or h[right].sum() < 1:
                    continue
                gain = sum(s * g[part].sum() ** 2 / (h[part].sum() + quality.SMOOTH) for s, part in ((1, left), (1, right), (-1, rows)))
                if gain > best[0] + 1e-12:
                    best = (gain, (j, c))
        if best[1] is None:
            return (0, np.inf, grow(rows, level + 1, g, h), 0.0)
        j, c = best[1]
        return (j, c, grow(rows[x[rows, j] <= c], level + 1, g, h), grow(rows[x[rows, j] > c], level + 1, g, h))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        model.append(grow(np.arange(len(y)), 0, y - p, p * (1 - p)))
        margin = margin + np.array([walk(model[-1], row) for row in x])
    return lambda rows: 1 / (1 + np.exp(-(base + np.array([sum(walk(t, r) for t in model) for r in rows]))))


def test_trees_equal_brute_force():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4))
    x[:, 3] = x[:, 2]  # equal gains: the first feature wins
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 120) > 0).astype(float)
    new = rng.normal(size=(200, 4))
    model = quality.fit(x, y, trees=6, depth=3, bins=8)
    assert model.scores(new) == pytest.approx(naive_fit(x, y, 6, 3, 8)(new))
    assert (model.feature != 3).all()


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(300)] + [(2, "other words !!")], "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=50)
    assert model.scores(np.zeros((3, quality._width()))).shape == (3,)
    scored = quality.score(docs.withColumn("score", F.lit(1)), model)
    assert scored.count() == 301 and quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0


# --- 6, 8, pieces --------------------------------------------------------------------------------
def test_topk_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0], 3) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumn("vector", F.lit("x"))
    got = topk.top_k(topk.quantised(df), F.col("vec_id") == 0, 3).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got)] == [(1, 1), (2, 2), (3, 3)]


def test_packing_of_repeated_rows_and_added_tokens(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (1, "a <|endoftext|> b"), (2, None)], "doc_id long, text string").withColumn("start", F.lit("x"))
    rows = packing.pack(docs.coalesce(1), with_ids=True).collect()
    ids = {(r["doc_id"], r["start"]): r["ids"] for r in rows}
    assert sum(r["length"] for r in rows) == 2 * 5 + 1 and 50256 in sum(ids.values(), [])
    assert packing.pack(docs.limit(0)).count() == 0


def test_pieces_cover_all_texts():
    import pyarrow as pa

    texts = ["", None, "a" * 50, "é" * 30, "b"] * 9
    got = list(common.pieces(pa.array(texts), 64))
    assert [t for _, _, part in got for t in part] == texts and [a for a, _, _ in got] == [0, *(b for _, b, _ in got[:-1])]


def test_documents_that_share_an_id_are_one(spark):
    rng = random.Random(30)
    x, y = words(rng, 40), words(rng, 40)
    rows = [(5, x), (5, y), (3, x), (9, y), (7, words(rng, 40)), (None, x)]
    got = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7), (None, None)}


# --- 4 -------------------------------------------------------------------------------------------
def test_template_text_is_left_out(spark):
    from scanforge.llm import html

    rng = random.Random(40)
    own = [words(rng, 30) for _ in range(7)]
    page = lambda t, i: f"<html><body><div class=wrap><div class=lead>Read all our stories here</div><div class=c><p class=a>{t}</p><p class=b>{i}</p><p class=z>Share this story</p></div></div></body></html>"
    rows = [(i, "http://one.example.com/x", page(t, f"number {i}")) for i, t in enumerate(own)] + [(100, "http://two.example.com/", page(own[0], "alone")), (101, None, None), (102, "http://one.example.com/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    # Alone, a page cannot tell its template; with its host it does.
    assert all(got[i] == f"{t} number {i}" for i, t in enumerate(own)) and got[100].endswith("Share this story") and got[101] == got[102] == ""
    assert html.extract(pages.limit(0)).count() == 0


def test_equal_pages_keep_their_text(spark):
    from scanforge.llm import html

    rows = [(i, "http://one.example.com/x", "<body><nav>a b</nav><article><h1>Title</h1><p>The same text</p></article></body>") for i in range(8)]
    assert {r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Title The same text"}


def test_hidden_layouts_are_shown():
    from scanforge.llm import html

    body = "<article><p>Body text</p></article>"
    for page in (f"<div class='layout with-sidebar'>{body}</div>", f"<form id=aspnetForm>{body}</form>", "<div id=page class=no-sidebar><p>Body text</p></div>", f"{body}<div class=related><article><p>Teaser</p></article></div>", f"<aside><article>Side</article></aside>{body}"):
        assert html.text_of(f"<html><body>{page}</body></html>", None) == "Body text"


def test_deep_and_wide_pages():
    from scanforge.llm import html

    deep = "<div>" * 100_000 + "deep text" + "</div>" * 7 + "<b>" * 2000 + " more"
    assert html.text_of(deep, None) == "deep text more"
    wide = ["<body>" + "".join(f"<p class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{k}'>t{i}</p>" for i in range(50_000)) + "</body>" for k in "xy"]
    wrapper = html.merged(*(html.wrapped(html.parse(p)) for p in wide))
    assert html.text_of(wide[0], html.region(wrapper)) == " ".join(f"t{i}" for i in range(50_000))


def test_alignment_is_longest_for_labels_that_differ():
    from scanforge.llm import html

    rng = random.Random(41)
    for _ in range(200):
        x, y = (rng.sample("abcdefghij", rng.randrange(10)) for _ in range(2))
        got = html.matched(x, y)
        assert all(x[i] == y[j] for i, j in got) and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)
        assert len(got) == longest_common(x, y)
    assert html.matched(list("aab"), list("aba")) in ([(0, 0), (2, 1)], [(0, 0), (1, 2)])
