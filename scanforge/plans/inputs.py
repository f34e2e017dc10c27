"""Domain tables derived from the driver's tables, in Spark and in SQL; both texts define the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw cube: 16 samples by 64 bands, with the embedding's label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("band", "e"))
    dn = F.floor((F.col("e").cast("double") + 1) * 2000).cast("double")
    return e.select(F.floor(F.col("vec_id") / 16).cast("long").alias("line"), (F.col("vec_id") % 16).cast("long").alias("sample"), F.col("band").cast("long").alias("band"), dn.alias("value"), "label")


CELLS = """cells AS (
  SELECT vec_id // 16 AS line, vec_id % 16 AS sample, i - 1 AS band, floor((embedding[i]::DOUBLE + 1) * 2000) AS value, label
  FROM embeddings, range(1, 65) t(i))"""


def dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).filter("label = 0").withColumn("value", F.col("value") / 2)


DARK = CELLS + ", dark AS (SELECT line, sample, band, value / 2 AS value FROM cells WHERE label = 0)"


def gains(spark: SparkSession, bands: int = 64, samples: int = 16) -> DataFrame:
    n = spark.range(bands * samples)
    band, sample = F.floor(F.col("id") / samples).cast("long"), F.col("id") % samples
    return n.select(band.alias("band"), sample.alias("sample"), (0.5 + (band * 31 + sample * 17) % 100 / 100).alias("gain"))


GAINS = "gains AS (SELECT b AS band, s AS sample, 0.5::DOUBLE + ((b * 31 + s * 17) % 100)::DOUBLE / 100 AS gain FROM range(64) x(b), range(16) y(s))"


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all users' events: a flight for each user."""
    e = table(spark, sf_dir, "events")
    t, v = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.col("value")
    return e.select(
        F.col("user_id").alias("flight"), "event_id", t.alias("time"), (50 + v % 10 / 100).alias("lat"), (-3 + v % 7 / 100).alias("lon"), (1000 + v).alias("hei"), (v % 7 - 3.5).alias("roll"), (v % 5 - 2.5).alias("pitch"), ((v * 7) % 360).alias("heading"),
    )


NAV = """nav AS (
  SELECT user_id AS flight, event_id, epoch_us(ts)::DOUBLE / 1e6 AS time, 50 + value % 10 / 100 AS lat, -3 + value % 7 / 100 AS lon, 1000 + value AS hei,
         value % 7 - 3.5::DOUBLE AS roll, value % 5 - 2.5::DOUBLE AS pitch, (value * 7) % 360 AS heading
  FROM events)"""


def scans(spark: SparkSession, sf_dir: str, step: float = 7200.0) -> DataFrame:
    """Scan times: regular within each flight."""
    n = nav(spark, sf_dir).groupBy("flight").agg(F.min("time").alias("a"), F.max("time").alias("b"))
    i = F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / step).cast("int"))).alias("scan")
    return n.select("flight", "a", i).select("flight", "scan", (F.col("a") + F.col("scan") * step).alias("time"))


SCANS = NAV + """, scans AS (
  SELECT flight, unnest(range(0, n + 1))::INTEGER AS scan, a + unnest(range(0, n + 1)) * 7200::DOUBLE AS time
  FROM (SELECT flight, min(time) AS a, floor((max(time) - min(time)) / 7200)::INTEGER AS n FROM nav GROUP BY flight))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel positions: 50 samples in a line."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.floor(k / 50).cast("long").alias("line"), (k % 50).alias("sample"), F.col("c_acctbal").alias("x"), ((k * 7919) % 10000).cast("double").alias("y"), F.col("c_nationkey").cast("double").alias("z"))


POINTS = "points AS (SELECT c_custkey // 50 AS line, c_custkey % 50 AS sample, c_acctbal AS x, ((c_custkey * 7919) % 10000)::DOUBLE AS y, c_nationkey::DOUBLE AS z FROM customer)"


def level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in three bands for the points; about one in seven is 0, the ignored value."""
    p = points(spark, sf_dir).select("line", "sample", F.explode(F.array(*[F.lit(b).cast("long") for b in range(3)])).alias("band"))
    return p.withColumn("value", ((F.col("line") * 50 + F.col("sample")) * (F.col("band") * 2 + 1) * 13 % 7 * 10).cast("double"))


LEVEL1 = "level1 AS (SELECT line, sample, b AS band, (((line * 50 + sample) * (b * 2 + 1) * 13) % 7 * 10)::DOUBLE AS value FROM points, range(3) t(b))"

#: The grid of the mapped queries: 500 by 500 over the points' extent.
LEFT, TOP, SIZE, ROWS, COLS, RADIUS = -1000.0, 10000.0, 500.0, 20, 22, 700.0
GRID = "grid AS (SELECT r AS row, c AS col, -1000 + (c + 0.5::DOUBLE) * 500 AS cx, 10000 - (r + 0.5::DOUBLE) * 500 AS cy FROM range(20) x(r), range(22) y(c))"


def dem(spark: SparkSession, rows: int = 60, cols: int = 60) -> DataFrame:
    n = spark.range(rows * cols)
    r, c = F.floor(F.col("id") / cols).cast("long"), F.col("id") % cols
    return n.select(r.alias("r"), c.alias("c"), ((r * 7 + c * 13) % 50).cast("double").alias("h"))


DEM = "dem AS (SELECT r, c, ((r * 7 + c * 13) % 50)::DOUBLE AS h FROM range(60) x(r), range(60) y(c))"
