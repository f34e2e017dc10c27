import random

import corpus_pipeline
from scanforge.llm import packing


def test_pipeline_keeps_what_each_stage_should(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    good = [(i, text(120)) for i in range(120)]
    bad = [(i, "BUY!! " * 60 + text(10).upper()) for i in range(120, 200)]
    copies = [(200, good[0][1]), (201, good[1][1] + " tail")]
    item = text(40)
    leaks = [(202, f"{text(50)} {item} {text(50)}")]
    rows = [(i, t, "en", "s", len(t)) for i, t in [*good, *bad, *copies, *leaks]]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{sf}/{name.replace(' ', '-')}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept == [set(range(120)) | {200, 201, 202}, set(range(120)) | {202}, set(range(120))]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(range(120))
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(tokens.values())
    assert tokens[5] == len(packing.encoder(packing.default_tokenizer())(good[5][1]))


def test_pipeline_of_empty_tables_and_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("none", []), ("some", [(1, None, None, None, None), (2, "", "en", None, 0), (None, "words of no id", None, None, 3), (3, "a text", None, "s", 6), (3, "a text", None, "s", 6)])):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted((r["doc_id"] or 0) for r in pieces if r["start"] == 0) == ([] if name == "none" else [0, 1, 3])
