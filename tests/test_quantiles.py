"""Radix selection against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.operators import quantiles

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 0), math.nextafter(2, 0), 2.0, 1.7976931348623157e308, math.inf, -math.inf, 1e300, -1e-300, 0.1, 8.98846567431158e307]


def bits(v):
    key = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -key if v < 0 else key


def test_keys_are_the_bits(spark):
    rng = random.Random(1)
    values = ODD + [struct.unpack("<d", struct.pack("<q", rng.randrange(1 << 63)))[0] for _ in range(2000)] + [2.0**e for e in range(-1074, 1024)]
    values = [v for v in values if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.order_key("v").alias("k")).collect()
    assert [(r.v, r.k) for r in rows] == [(v, bits(v)) for v in values]
    assert spark.createDataFrame([(None,), (math.nan,)], "v double").select(quantiles.order_key("v").alias("k")).where("k IS NOT NULL").count() == 0


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(2)
    groups = {"wide": rng.standard_normal(5000) * 10.0 ** rng.integers(-200, 200, 5000), "few": rng.integers(0, 3, 4000).astype(float), "one": np.array([7.5]), None: rng.random(100), "near": 1 + rng.integers(0, 50, 999) * 2.0**-52}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("none", math.nan), ("few", None)]
    shares = (0.0, 0.025, 0.5, 0.9, 1.0)
    frame = spark.createDataFrame(data, "g string, v double").repartition(7)
    found = {r["g"]: r for r in quantiles.exact_quantiles(frame, ["g"], "v", shares).collect()}
    assert found.keys() == {*groups, "none"} and found["none"]["n"] == 0 and found["none"]["q"] is None
    for g, vs in groups.items():
        assert found[g]["n"] == len(vs) and found[g]["q"] == pytest.approx(np.quantile(vs, shares).tolist(), rel=1e-12)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(empty, ["g"], "v", (0.5,)).count() == 0
    whole = quantiles.exact_quantiles(spark.range(11).select(F.col("id").alias("v")), [], "v", (0.5, 0.25)).first()
    assert (whole["n"], whole["q"]) == (11, [5.0, 2.5])
