import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import stores, timeline
from tidemark.streaming import stateful, streams


def played(spark, tmp_path, parts, schema):
    """A stream of the given parts, a file and so a batch each."""
    path = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_events(spark, path, spark.createDataFrame([], schema).schema)


def test_limiter_equals_the_batch_form_over_the_events(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_micros(F.to_timestamp("ts")).alias("ts"))
    want = {(r.user_id, r.event_id): r.n < 3 for r in timeline.hits_before(events.withColumnRenamed("ts", "at"), "user_id", "at", 6 * 3600 * 10**6).collect()}
    rows = sorted(map(tuple, events.collect()), key=lambda r: r[2])
    parts = [rows[s : s + 400] for s in range(0, len(rows), 400)]  # in order of time, some hits of one instant apart
    src = played(spark, tmp_path, parts, "user_id long, event_id long, ts long")
    streams.run_available(stateful.limited(src, 3, 6 * 3600, 3600), "limits_tws", "append", str(tmp_path / "c"))
    got = {(r.user_id, r.event_id): r.allowed for r in spark.table("limits_tws").collect()}
    assert got == want


def test_limiter_forgets(spark, tmp_path):
    parts = [[(1, 1, 0)], [(2, 2, 10_000 * 10**6)], [(3, 3, 20_000 * 10**6)]]
    src = played(spark, tmp_path, parts, "user_id long, event_id long, ts long")
    streams.run_available(stateful.limited(src, 5, 60, late=100), "forgotten_tws", "append", str(tmp_path / "c"))
    assert spark.table("forgotten_tws").filter("allowed").count() == 3
    left = stateful.state_rows(spark, str(tmp_path / "c"), "hits").collect()
    assert [r.key.user_id for r in left] == [3]  # the last user's alone


def test_yields_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    runs = [[(s, n, rng.choice([0, 0, 0, 1, 5, 13])) for s in "abc" if rng.random() < 0.9] for n in range(9)]
    src = played(spark, tmp_path, [*runs, runs[3]], "source string, run long, n long")  # a run that comes again
    streams.run_available(stateful.yields(src), "yields_tws", "append", str(tmp_path / "c"))
    got = {(r.source, r.run): (r.ema, r.history, r.disabled) for r in spark.table("yields_tws").collect()}
    assert len(got) == sum(map(len, runs))
    states = {s: spark.createDataFrame([], "source string, ema double, history array<long>") for s in "abc"}
    for n, rows in enumerate(runs):
        for s, _, count in rows:
            after = stores.yields_after(states[s], spark.createDataFrame([(s, count)], "source string, n long")).first()
            assert got[s, n] == (after.ema, ",".join(map(str, after.history)), after.disabled)
            states[s] = spark.createDataFrame([(s, after.ema, after.history)], "source string, ema double, history array<long>")
    assert {(r.key.source, r.value.run) for r in stateful.state_rows(spark, str(tmp_path / "c"), "ema").collect()} == {(s, max(r for x, r, _ in sum(runs, []) if x == s)) for s in "abc"}


def test_expansions_equal_the_definition_over_the_events(spark, tmp_path, sf_dir):
    day = 86400
    counts = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'").groupBy(F.col("user_id").cast("string").alias("company"), (F.unix_date(F.to_date("ts")).cast("long") * day).alias("start")).agg(F.count("*").alias("n"))
    rows = sorted(map(tuple, counts.collect()), key=lambda r: (r[1], r[0]))
    known = {(c, s): n for c, s, n in rows}
    want = {(c, s, n) for (c, s), n in known.items() if (c, s - day) not in known and any((c, s - k * day) in known for k in (2, 3, 4))}
    days = sorted({s for _, s, _ in rows})
    src = played(spark, tmp_path, [[r for r in rows if r[1] == d] for d in days] + [[("end", days[-1] + 40 * day, 1)], [("end", days[-1] + 41 * day, 1)]], "company string, start long, n long")
    streams.run_available(stateful.expansions(src, day), "expansions_tws", "append", str(tmp_path / "c"))
    got = {(r.company, r.start, r.n) for r in spark.table("expansions_tws").collect()}
    assert want and got == want
    assert {r.key.company for r in stateful.state_rows(spark, str(tmp_path / "c"), "counts").collect()} == {"end"}
