"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, lm, neardup, packing, quality, topk, url_filter, warc
from .common import new_path, read, remainder


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    back = chat.read_back(chat.format_chat(turns.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)((?:/?INST|/?ROLE|IMAGE|AUDIO|DOCUMENT)\])', '[\\\1\2', 'g'))
       + length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)((?:/?INST|/?ROLE|IMAGE|AUDIO|DOCUMENT)\])', '[\\\1\2', 'g'))
       + length('<s>[ROLE]') + length('[/ROLE]') + length('</s>') AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_and_list(spark))
    rule = F.when(F.col("matched_rank") == 0, F.col("matched"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("matched_verdict", F.lit("allow")).alias("verdict"))


_LISTED = ", ".join(f"('{key}', 1, 'block')" for key in url_filter.sample_list())
OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, url, row_number() OVER () AS i,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), e(key, rank, verdict) AS (
  VALUES ('com/en/', 0, 'block'), ('example.com/en/7', 0, 'allow'), ('net/de/', 0, 'block'), ('example.net/de/8', 0, 'block'), ('org/es/', 0, 'block'), {_LISTED}
), m AS (
  SELECT u.*, e.*, row_number() OVER (PARTITION BY i ORDER BY rank, length(key) DESC NULLS LAST) AS best
  FROM u LEFT JOIN e ON host <> '' AND ends_with('.' || host, '.' || split_part(key, '/', 1)) AND starts_with(path, key[length(split_part(key, '/', 1)) + 1 :])
)
SELECT page_id, host, path, CASE WHEN rank = 0 THEN key END AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE best = 1
"""


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), "quality", remainder("doc_id", 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    model = lm.train(docs, ~held_out)
    scored = lm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS kept FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < kept THEN kept END AS refers_to FROM k
"""

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_neardup, op3_url_filter, op4_html_extract, op5_quality, op6_exact_topk, op7_lm_score, op8_packing, op9_decontam, op10_warc)}
SQL = {"op1_chat_format": OP1_SQL, "op3_url_filter": OP3_SQL, "op6_exact_topk": OP6_SQL, "op10_warc": OP10_SQL}
