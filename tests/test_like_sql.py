"""Registered queries against their SQL on small tables with ties, halves and copies."""

import threading

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanforge.operators import calibration as cal
from scanforge.operators import geolocation as geo


def same_as_sql(spark, path, name, **tables):
    """tables: name to a query that makes it."""
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for table, text in tables.items():
        db.sql(f"COPY ({text}) TO '{path}/{table}.parquet'")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got = entry.queries()[name](spark, str(path))
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key) and want


def test_cubic_with_equal_places_r5(spark, tmp_path):
    same_as_sql(spark, tmp_path, "cubic_r5", customer="SELECT range AS c_custkey, 1::INTEGER AS c_nationkey, (range * 37 % 45 * 250 - 1000)::DOUBLE AS c_acctbal FROM range(6000)")


def test_half_seconds_round_to_even_w13(spark, tmp_path):
    events = "SELECT range AS event_id, TIMESTAMP '2024-01-01 23:59:00' + to_microseconds((range * 500000)::BIGINT) AS ts, range % 3 AS user_id, 1.0::DOUBLE AS value FROM range(400)"
    same_as_sql(spark, tmp_path, "day_rollover_w13", events=events)


@pytest.mark.parametrize("name", ["wavelength_match_j6", "trim_gains_c5", "remap_bad_j7"])
def test_copies_of_bands_j6_c5_j7(spark, tmp_path, name):
    same_as_sql(spark, tmp_path, name, part="SELECT range AS p_partkey, (range % 50)::INTEGER AS p_size, (900 + range % 40 * 0.003)::DOUBLE AS p_retailprice FROM range(400)")


def test_copies_of_a_wavelength_cost_no_pairs_j6(spark):
    bands = spark.range(300_000).select(F.col("id").alias("band"), F.lit(500.0).alias("wavelength"))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert cal.match_wavelengths(bands, bands).groupBy("cal_band").count().collect() == [(0, 300_000)]
    finally:
        stop.cancel()


def test_rays_of_a_tile_go_in_groups_j18(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geo, "RAYS_PER_GROUP", 20)
    same_as_sql(spark, tmp_path, "ray_dem_j18", supplier="SELECT range AS s_suppkey, (range % 25)::INTEGER AS s_nationkey FROM range(20)")
