"""Totals per key with one key of most rows, with many keys, and in several steps of the reduction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import accumulate
from pathloom.operators.accumulate import heavy_keys, key_totals


def rows(n=3000, keys=50, seed=1):
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.4, 7, rng.integers(-keys, keys, n))
    return [(None if i % 97 == 0 else int(x), None if i % 13 == 0 else int(rng.integers(0, 10**6)), None if i % 5 == 0 else float(rng.normal()), "r") for i, x in enumerate(k)]


@pytest.mark.parametrize("partitions, held", [(1, 10**6), (40, 10**6), (40, 3)])
def test_totals(spark, monkeypatch, partitions, held):
    monkeypatch.setattr(accumulate, "HELD_KEYS", held)
    monkeypatch.setattr(accumulate, "FAN_IN", 4)
    df = spark.createDataFrame(rows(), "subid int, us long, miles double, rows string").repartition(partitions)
    got = {r["subid"]: r for r in key_totals(df, "subid", "us", "miles").collect()}
    want = {r["subid"]: r for r in df.filter("subid IS NOT NULL").groupBy("subid").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"), F.coalesce(F.sum("miles"), F.lit(0.0)).alias("t")).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k]["rows"], got[k]["first_us"], got[k]["last_us"]) == (w["n"], w["a"], w["b"])
        assert got[k]["total"] == pytest.approx(w["t"], abs=1e-9)


def test_many_keys(spark):
    df = spark.range(20_000).select((F.col("id") * 1_000_003).alias("k"))
    t = key_totals(df, "k")
    assert t.count() == 20_000 and t.filter("rows <> 1 OR first_us IS NOT NULL").count() == 0


def test_heavy_keys(spark):
    df = spark.createDataFrame(rows(), "subid int, us long, miles double, rows string")
    assert [r["subid"] for r in heavy_keys(df, "subid", 0.2).collect()] == [7]
    assert heavy_keys(df.limit(0), "subid").count() == 0
