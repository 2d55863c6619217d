import bisect
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sketches
from tidemark.plans import records

START = dt.datetime(2024, 1, 1)


def exact_psi(old, new, bins=10):
    old, new = sorted(old), sorted(new)
    edges = sorted({old[max(0, math.ceil(len(old) * k / bins) - 1)] for k in range(1, bins)})
    upto = lambda v: [bisect.bisect_right(v, e) / len(v) for e in edges] + [1.0]
    e, a = ([max(x - y, 0.5 / len(v)) for x, y in zip(upto(v), [0, *upto(v)])] for v in (old, new))
    return sum((y - x) * math.log(y / x) for x, y in zip(e, a))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(START + dt.timedelta(hours=rng.randrange(24 * 28)), rng.gauss(100, 15) + (8 if k % 2 else 0), rng.randrange(3000)) for k in range(20000)]


def test_merges_of_days_stay_within_the_bounds(spark, rows):
    df = spark.createDataFrame([*rows, (None, 5.0, 1), (START, None, None), (START, float("nan"), 1)], "ts timestamp, v double, item int")
    days = sketches.daily(df, "ts", "v", "item").cache()
    assert days.count() == 28
    for low, high in ((0, 7), (0, 28), (13, 14)):
        span = days.filter(F.col("day").between(F.lit(START.date() + dt.timedelta(low)), F.lit(START.date() + dt.timedelta(high - 1))))
        got = sketches.merged(span).select("n", *[sketches.quantile("quantiles", p / 100).alias(f"p{p}") for p in (10, 50, 90)], sketches.distinct("items").alias("d")).first()
        inside = [(v, i) for t, v, i in rows if low <= (t - START).days < high]
        v = sorted(x for x, _ in inside)
        assert abs(got.n - len(inside)) <= 2
        for p in (10, 50, 90):
            assert abs(bisect.bisect_left(v, got[f"p{p}"]) / len(v) - p / 100) < 0.03
        many = len({i for _, i in inside})
        assert abs(got.d - many) < 0.05 * many + 3


def test_drift_does_not_depend_on_how_days_are_grouped(spark, rows):
    df = spark.createDataFrame([(t, v, i) for t, v, i in rows], "ts timestamp, v double, item int")
    days = sketches.daily(df, "ts", "v", "item").cache()
    old, new = days.filter(F.col("day") < F.lit(START.date() + dt.timedelta(14))), days.filter(F.col("day") >= F.lit(START.date() + dt.timedelta(14)))
    weekly = lambda d: sketches.merged(sketches.merged(d, (F.date_trunc("week", "day").alias("w"),)))
    moved = new.select("day", "n", "quantiles", "items")
    far = sketches.daily(df.withColumn("v", F.col("v") + 25), "ts", "v", "item").filter(F.col("day") >= F.lit(START.date() + dt.timedelta(14)))
    for grouped in (sketches.merged, weekly):
        same, apart = (sketches.drift(grouped(old), grouped(x)).first() for x in (moved, far))
        assert not same.drifted and same.psi < 0.02 and apart.drifted
        before, after = ([v for t, v, _ in rows if ((t - START).days < 14) == first] for first in (True, False))
        want = exact_psi(before, [v + 25 for v in after])
        assert abs(apart.psi - want) < 0.15 * want


def test_no_values(spark):
    none = sketches.merged(sketches.daily(spark.createDataFrame([(START, None, None)], "ts timestamp, v double, item int"), "ts", "v", "item"))
    some = sketches.merged(sketches.daily(spark.createDataFrame([(START, 1.0, 1), (START, 1.0, 2)], "ts timestamp, v double, item int"), "ts", "v", "item"))
    assert tuple(sketches.drift(none, some).first()) == (None, False) and tuple(sketches.drift(some, none).first()) == (None, False)
    assert none.select(sketches.quantile("quantiles", 0.5).alias("q")).first().q is None
    assert not sketches.drift(some, some).first().drifted


def test_the_registered_drift_agrees_with_the_exact_figure(spark, sf_dir):
    got = records.sketch_drift(spark, sf_dir).first()
    prices = [(r.o_totalprice, r.o_orderdate.year < 1998) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()]
    want = exact_psi([p for p, old in prices if old], [p for p, old in prices if not old])
    assert abs(got.psi - want) < 0.05 and not got.drifted
