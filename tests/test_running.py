"""Running sums and exact quantiles over skewed values, in many and in few parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.functions.running import cut, keyed_rank, quantiles, running
from ballast.sources.stored import stored


def skewed(kind: str) -> list[float]:
    r = random.Random(1)
    return {
        "outlier": [r.random() * 1e-4 for _ in range(4000)] + [1e6],
        "one value": [0.25] * 3000 + [r.random() for _ in range(500)],
        "scales": [10.0 ** r.uniform(-200, 200) * r.choice([-1, 1]) for _ in range(1500)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324] + [float(i) for i in range(500)],
        "same": [3.0] * 40,
        "few": [2.0, 1.0],
        "one": [7.0],
    }[kind]


KINDS = ["outlier", "one value", "scales", "ends", "same", "few", "one"]


@pytest.mark.parametrize("kind", KINDS)
def test_quantiles(spark, kind):
    x = skewed(kind)
    shares = [0.0, 0.1, 0.25, 0.5, 0.7, 0.75, 0.999, 1.0]
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "v double")
    got = quantiles(df, "v", shares, buckets=64)
    assert np.allclose(got, np.quantile(x, shares), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("kind", KINDS)
def test_running_and_its_parts(spark, kind):
    x = skewed(kind)
    df = spark.createDataFrame(list(enumerate(x)), "id long, v double")
    for small in (0, 1 << 16):
        got = running(df, "v", ["id"], {"rn": F.lit(1), "ids": F.col("id")}, buckets=64, small=small).collect()
        order = sorted(range(len(x)), key=lambda i: (x[i], i))
        ids = np.cumsum(order)
        want = {i: (k + 1, int(ids[k])) for k, i in enumerate(order)}
        assert {r["id"]: (r["rn"], r["ids"]) for r in got} == want
    parts = cut(stored(df, "rows"), "v", "part", 64).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("values")).collect()
    mean = -(-len(x) // 64)
    assert all(r["n"] <= 2 * mean or r["values"] == 1 for r in parts)


def test_keyed_rank_of_a_hot_key(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else r.choice([None, "a", "b"]), x) for x in r.sample(range(10**6), 900)]
    df = spark.createDataFrame(rows, "k string, o long")
    for small in (0, 1 << 16):
        got = {r["o"]: r["n"] for r in keyed_rank(df, ["k"], "o", "n", buckets=32, small=small).collect()}
        assert got == {o: sum(p <= o for j, p in rows if j == k) for k, o in rows}
