"""URL filters (operator 3), in DataFrame functions alone.

Entries are canonical URLs without scheme, `host/path`: an entry fits its host and all subdomains,
if the url's path starts with the entry's. Its blocked Bloom filter is an aggregate (bit_or) of one
512-bit block per group of keys; it has a row per block, so its size follows the list, and it is
broadcast only after its size is checked. A url's keys are its host's suffixes times its path's
prefixes of the lengths that the list has for such a suffix depth; keys that the filter passes are
joined to the list exactly, which removes false positives. The longest entry wins.

Urls are judged once each: only distinct urls that pass the filter reach the joins. The verdicts are
stored and then broadcast if they are few; else rows meet their verdict by url, in a join that Spark
can split at a hot url, and urls without a host are dealt over SALTS keys. Null urls and urls
without `://` have empty host and path and fit nothing. Repeated rows are judged each; extra
columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored

WORDS, BITS = 8, 6
KEYS_PER_BLOCK = 32
SALTS = 1024

#: The contract's rules.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: A sample list of unwanted sites, one canonical URL a line.
SAMPLE_LIST = Path(__file__).with_name("listed_urls.txt")


def sample_list() -> list[str]:
    return [line for line in SAMPLE_LIST.read_text(encoding="utf-8").splitlines() if line and not line.startswith("#")]


def rules_and_list(spark: SparkSession, listed: DataFrame | None = None) -> DataFrame:
    """The table that judge() reads: the contract's rules, then the canonical URLs (column key) of a list to block."""
    if listed is None:
        listed = spark.createDataFrame([(k,) for k in sample_list()], "key string")
    rules = spark.createDataFrame([(k, 0, v) for k, v in RULES], "key string, rank int, verdict string")
    return rules.unionByName(listed.select("key", F.lit(1).alias("rank"), F.lit("block").alias("verdict")))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _positions(key: Column) -> Column:
    """BITS bit numbers of 0..511 from a second hash, 9 bits each."""
    h = F.xxhash64(key, F.lit(1))
    return F.array(*[F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(BITS)])


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, words array<long>)."""
    bits = entries.select(_block(F.col("key"), blocks).alias("block"), F.explode(_positions(F.col("key"))).alias("bit"))
    word = lambda w: F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, cast(bit % 64 as int))"))), F.lit(0).cast("long"))
    return bits.groupBy("block").agg(F.array(*[word(w) for w in range(WORDS)]).alias("words"))


def judge(pages: DataFrame, entries: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path and, from entries (key, rank, verdict), the best: rank first, then the longest key.

    Adds matched (the key), matched_verdict and matched_rank; null where nothing fits.
    """
    key = F.col("key")
    entries = entries.filter(F.instr(key, "/") > 0).dropDuplicates(["key", "rank"])
    shapes = entries.select(F.size(F.split(F.substring_index(key, "/", 1), r"\.")).alias("labels"), (F.char_length(key) - F.instr(key, "/") + 1).alias("length")).groupBy("labels").agg(F.collect_set("length").alias("lengths"))
    blocks = max(1, -(-entries.count() // KEYS_PER_BLOCK))
    bloom = bloom_filter(entries, blocks)
    p = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    # Keys: suffixes of the host with as many labels as some entry has, path prefixes of that shape's lengths.
    sites = p.filter("host <> ''").select("host", "path").distinct()
    split = sites.withColumn("parts", F.split("host", r"\."))
    depth = split.select("host", "path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("labels"))
    suffix = F.array_join(F.slice("parts", F.size("parts") - F.col("labels") + 1, F.col("labels")), ".")
    keyed = depth.join(small(shapes, 64), "labels").select("host", "path", suffix.alias("suffix"), F.explode("lengths").alias("length"))
    keyed = keyed.filter(F.char_length("path") >= F.col("length")).select("host", "path", F.concat("suffix", F.expr("left(path, length)")).alias("key"))
    probed = keyed.withColumns({"block": _block(key, blocks), "bits": _positions(key)}).join(small(bloom, 128), "block")
    hit = "forall(bits, x -> (shiftrightunsigned(element_at(words, cast(x div 64 as int) + 1), cast(x % 64 as int)) & 1) = 1)"
    passed = probed.filter(F.expr(hit))
    exact = passed.select("host", "path", "key").join(small(entries.select("key", "rank", "verdict"), 256), "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct((-F.col("rank")).alias("order"), F.char_length("key").alias("length"), F.char_length(F.substring_index("key", "/", 1)).alias("host_length"), "key", "verdict")).alias("best"))
    verdicts = best.select("host", "path", F.col("best.key").alias("matched"), F.col("best.verdict").alias("matched_verdict"), (-F.col("best.order")).alias("matched_rank"))
    verdicts = stored(verdicts.withColumn("salt", F.lit(0).cast("long")), "verdicts")
    # Urls without a host fit nothing and may be many: they are dealt over SALTS keys that no verdict has.
    salt = F.when(F.col("host") == "", 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    return p.withColumn("salt", salt).join(small(verdicts, 512), ["host", "path", "salt"], "left").drop("salt")
