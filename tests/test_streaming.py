import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import stateful, streams

START = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(path)
    return streams.read_events(spark, path, df.schema)


def test_weeks_and_sessions(spark, tmp_path):
    rows = [(1, START + dt.timedelta(hours=h)) for h in (0, 3, 30, 24 * 7 + 1, 24 * 30)]
    src = stream(spark, tmp_path, rows, "user_id long, ts timestamp")
    streams.run_available(streams.weekly_counts(src, "user_id"), "weeks", "append", str(tmp_path / "c1"))
    got = sorted((r.week_start, r.n) for r in spark.table("weeks").collect())
    assert got == [(START, 3), (START + dt.timedelta(days=7), 1)]  # the last week is still open
    streams.run_available(streams.session_counts(src, "user_id"), "sessions", "append", str(tmp_path / "c2"))
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 1, 2]


def test_first_seen(spark, tmp_path):
    rows = [(k % 3, START + dt.timedelta(minutes=k)) for k in range(9)]
    src = stream(spark, tmp_path, rows, "user_id long, ts timestamp")
    streams.run_available(streams.first_seen(src, ["user_id"]), "firsts", "append", str(tmp_path / "c"))
    assert sorted(r.user_id for r in spark.table("firsts").collect()) == [0, 1, 2]


def test_limiter_equals_the_definition(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(3), n, rng.randrange(300) * 10**6) for n in range(80)]
    src = stream(spark, tmp_path, rows, "user_id long, event_id long, ts long")
    streams.run_available(stateful.limited(src, 5, 60), "limits", "append", str(tmp_path / "c"))
    got = {r.event_id: r.allowed for r in spark.table("limits").collect()}
    want = {e: sum(v == u and s - 60 * 10**6 <= t < s for v, _, t in rows) < 5 for u, e, s in rows}
    assert got == want


def test_limiter_forgets_users_of_long_ago(spark, tmp_path):
    path = str(tmp_path / "in")
    for user, second in ((1, 0), (2, 10_000), (3, 20_000)):
        spark.createDataFrame([(user, user, second * 10**6)], "user_id long, event_id long, ts long").coalesce(1).write.mode("append").parquet(path)
    src = streams.read_events(spark, path, "user_id long, event_id long, ts long")
    streams.run_available(stateful.limited(src, 5, 60, late=100), "forgotten", "append", str(tmp_path / "c"))
    assert [r.key.user_id for r in stateful.state_rows(spark, str(tmp_path / "c"), "hits").collect()] == [3]  # the last user alone
    assert spark.table("forgotten").filter("allowed").count() == 3


def seen(store):
    return {r.dedup_hash: r.times_seen for r in store.read().collect()}


def test_seen_store_counts_each_batch_once(spark, tmp_path):
    batch = lambda *keys: spark.createDataFrame([(k, START) for k in keys], "dedup_hash string, ts timestamp")
    store = streams.SeenStore(spark, str(tmp_path / "seen"), "first")
    assert seen(store) == {}
    store.write(batch("a", "b", "b"), 0)
    for _ in range(2):
        store.write(batch("b", "c"), 1)
    assert seen(store) == {"a": 1, "b": 3, "c": 1}
    store.fold()
    store.write(batch("b", "c"), 1)  # run again after the fold
    assert seen(store) == {"a": 1, "b": 3, "c": 1}
    again = streams.SeenStore(spark, str(tmp_path / "seen"), "second", every=2)  # a new checkpoint starts at 0
    again.write(batch("a"), 0)
    again.write(batch(), 1)  # nothing came; folds
    assert seen(again) == seen(store) == {"a": 2, "b": 3, "c": 1}
    assert sorted(p.name for p in (tmp_path / "seen").iterdir()) == ["base=1"]
    for name in ("", "a=b", "a/b"):
        with pytest.raises(ValueError):
            streams.SeenStore(spark, str(tmp_path / "seen"), name)
    assert streams.as_instant(batch("a").withColumn("ts", F.col("ts").cast("timestamp_ntz"))).schema["ts"].dataType.simpleString() == "timestamp"


def test_seen_store_as_the_sink_of_a_stream(spark, tmp_path):
    src = stream(spark, tmp_path, [("a", START), ("a", START + dt.timedelta(days=1)), ("b", START)], "dedup_hash string, ts timestamp")
    store = streams.SeenStore(spark, str(tmp_path / "seen"), "run")
    src.writeStream.foreachBatch(store.write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", START, START + dt.timedelta(days=1), 2), ("b", START, START, 1)]
