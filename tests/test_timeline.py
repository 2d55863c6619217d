import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeline

SCHEMA = "user_id string, event_id long, at long"


def events(rng, n):
    """A third of all rows have one key."""
    return [("hot" if rng.random() < 0.34 else rng.choice(["a", "b", None]), k, rng.randrange(60 * n // 100) * 10) for k in range(n)]


@pytest.mark.parametrize("slices", [1, 7, 24])
def test_hits_before_equal_the_definition(spark, slices):
    rows = events(random.Random(slices), 400)
    rows += [rows[0], ("hot", 9000, None)]
    found = timeline.hits_before(spark.createDataFrame(rows, SCHEMA), "user_id", "at", 500, slices)
    want = sorted((str(u), e, 0 if t is None else sum(v == u and s is not None and t - 500 <= s < t for v, _, s in rows)) for u, e, t in rows)
    assert sorted((str(r.user_id), r.event_id, r.n) for r in found.collect()) == want


@pytest.mark.parametrize("slices", [1, 7, 24])
def test_sessions_equal_the_definition(spark, slices):
    rows = events(random.Random(slices), 300)
    want = []
    for user in {r[0] for r in rows}:
        last, number = None, 0
        for t, e in sorted((t, e) for u, e, t in rows if u == user):
            number += last is None or t - last > 20
            want.append((str(user), e, number))
            last = t
    found = timeline.sessions(spark.createDataFrame(rows, SCHEMA), "user_id", "at", "event_id", 20, slices)
    assert sorted((str(r.user_id), r.event_id, r.session) for r in found.collect()) == sorted(want)
    assert max(n for _, _, n in want) > 3


def test_a_hot_key_spans_slices_of_like_size(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 37 % 6000).alias("at"))
    found = timeline.sliced(rows, "user_id", ["at", "event_id"], 30).groupBy("_slice").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") == "hot").alias("hot")).collect()
    assert sum(r.n for r in found) == 6000 and max(r.n for r in found) < 6000 // 10 and sum(r.hot > 0 for r in found) >= 8


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert timeline.hits_before(none, "user_id", "at", 5).collect() == [] and timeline.sessions(none, "user_id", "at", "event_id", 5).collect() == []
