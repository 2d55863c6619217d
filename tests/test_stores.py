import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import stores

DAY = dt.datetime(2024, 1, 10)
SEEN = "dedup_hash string, first_seen timestamp, last_seen timestamp, times_seen long"


def ago(n):
    return DAY - dt.timedelta(days=n)


def test_seen_store_freezes_until_expiry(spark):
    now = F.lit(DAY)
    seen = spark.createDataFrame([("a", ago(9), ago(5), 2), ("b", ago(90), ago(40), 1)], SEEN)
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c")], "job_id int, dedup_hash string")
    new = stores.filter_new(batch, seen, now, [F.col("job_id")])
    assert sorted(r.job_id for r in new.collect()) == [2, 3]
    after = {r.dedup_hash: r for r in stores.mark_seen(seen, new, now).collect()}
    assert after["a"].last_seen == ago(5) and after["b"].first_seen == ago(90) and after["b"].times_seen == 2 and after["c"].times_seen == 1


def test_upserts(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, name string, run int")
    new = spark.createDataFrame([(2, "z", 2), (3, "w", 2), (3, "v", 2)], "id int, name string, run int")
    assert sorted(map(tuple, stores.upsert_first_wins(old, new, "id", ("run",)).collect())) == [(1, "x", 1), (2, "y", 2), (3, "v", 2)]
    assert sorted(map(tuple, stores.append_unknown(old, new, ["id"]).collect())) == [(1, "x", 1), (2, "y", 1), (3, "v", 2)]
    assert sorted(map(tuple, stores.latest(old.union(new), ["id"], "run").select("id", "name").collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_yields_and_sources(spark):
    states = spark.createDataFrame([("a", 1.0, [0, 0]), ("b", 4.0, [3, 0, 0, 5])], "source string, ema double, history array<long>")
    counts = spark.createDataFrame([("b", 2), ("c", 7)], "source string, n long")
    got = {r.source: r for r in stores.yields_after(states, counts).collect()}
    assert (got["a"].history, got["a"].disabled, got["a"].ema) == ([0, 0, 0], True, 0.7)
    assert (got["b"].history, got["b"].disabled, got["b"].ema) == ([0, 0, 5, 2], False, 3.4)
    assert got["c"].ema == 2.8


def test_weeks_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "w")
    stores.save_weeks(spark.createDataFrame([("2024-01-01", 1), ("2024-01-08", 2)], "week_start string, n int"), path)
    stores.save_weeks(spark.createDataFrame([("2024-01-08", 3)], "week_start string, n int"), path)
    assert sorted((str(r.week_start), r.n) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-08", 3)]


def test_state_defaults_and_log(spark):
    states = spark.createDataFrame([("a", 3, 0, "{}")], "agent_id string, run_count int, consecutive_failures int, adaptive_params string")
    got = {r.agent_id: r.run_count for r in stores.load_state(states, spark.createDataFrame([("a",), ("b",)], "agent_id string")).collect()}
    assert got == {"a": 3, "b": 0}
    log = spark.createDataFrame([(list(range(10)),), (None,)], "l array<int>").select(stores.last_entries(F.col("l"), F.lit(10), 10).alias("l")).collect()
    assert log[0].l == list(range(1, 11)) and log[1].l == [10]
