import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import hot_keys, salted_join, sized_join, with_group


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_one(spark, how):
    rng = random.Random(4)
    left = spark.createDataFrame([(None if n % 50 == 0 else 7 if n % 3 == 0 else rng.randint(0, 300), n) for n in range(5000)], "k long, v int")
    right = spark.createDataFrame([(k, k * 2) for k in range(250)], "k long, w long")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "k", 5000)
    assert 0 < hot.count() <= 1000
    rows = lambda df: sorted(df.select("k", "v", "w").collect(), key=str)
    assert rows(salted_join(left, right, "k", hot, how)) == rows(left.join(right, "k", how))


def test_a_hot_key_is_spread(spark):
    left = spark.range(8000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    assert hot_keys(groups, "k", 8000).first()._salts == 1000
    assert with_group(left, "k", 8000, low=F.min("v")).filter("n = 8000 and low = 0").count() == 8000


def test_sized_join_equals_a_plain_one(spark):
    left = spark.range(5000).select(F.expr("if(id % 3 = 0, 7, id % 90)").alias("k"), F.col("id").alias("v"))
    left = with_group(left, "k", 5000)
    right = left.groupBy("k").agg(F.max("v").alias("w"), F.first("n").alias("n"))
    rows = lambda df: sorted(df.select("k", "v", "w", "n").collect())
    assert rows(sized_join(left, right, "k", "n", 5000)) == rows(left.join(right.drop("n"), "k"))
