import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans import dataflow, serving
from tidemark.sources.schemas import conform

NOW = dt.datetime(2024, 1, 3, 12)
JOBS = "job_id string, title string, company string, location string, description string, source string, work_model string, dedup_hash string, role_category string, salary_min double, salary_max double, offers_sponsorship boolean, is_startup boolean, scraped_at timestamp"
SEEN = "dedup_hash string, first_seen timestamp, last_seen timestamp, times_seen long"
SKILLS = "job_id string, skill string, skill_category string, extraction_method string, confidence double"


def test_weekly_run(spark):
    raw = spark.createDataFrame(
        [("1", "Senior ML Engineer", "Acme", "London", "PyTorch and Docker. £90,000 - £130,000. " + "x " * 90, "a", "remote"), ("2", "senior ml engineer", "ACME ", "london", "copy", "b", "remote"), ("3", "Data Scientist", "Beta", "Leeds", "Short.", "a", "onsite")],
        "job_id string, title string, company string, location string, description string, source string, work_model string",
    )
    kept, shape = {}, []
    sinks = {name: (lambda df, n=name: kept.__setitem__(n, df.collect())) for name in ("jobs", "seen", "skills", "snapshot")}
    more = {name: (lambda df, n=name: kept.__setitem__(n, df.collect())) for name in dataflow.HISTORIES}
    sinks["snapshot"] = lambda df: (shape.append(df.schema), kept.__setitem__("snapshot", df.collect()))
    empty = lambda schema: spark.createDataFrame([], schema)
    run = dataflow.weekly(raw, empty(JOBS), empty(SKILLS), empty(SEEN), F.lit(NOW), "2024-01-01", sinks)
    assert run.passed and run.steps["collected"] == {"new": 2, "sources": 1}
    assert {r.job_id for r in kept["jobs"]} == {"1", "3"} and len(kept["seen"]) == 2
    skills = {(r.job_id, r.skill, r.extraction_method) for r in kept["skills"]}
    assert ("1", "PyTorch", "taxonomy") in skills and ("3", "Pandas", "role_inference") in skills
    snap = {r.role_category: r for r in kept["snapshot"]}
    assert snap["all"].job_count == 2 and snap["all"].remote_rate == 0.5 and snap["all"].quality == "poor" and snap["ml_engineer"].top_skills[0].r == 1
    assert snap["all"].top_cities[0].n == 1 and snap["all"].salary_sample_size == 1 and snap["all"].computed_at == NOW
    stored = conform(spark.createDataFrame(kept["snapshot"], shape[0]), "weekly_snapshots")
    assert serving.trending_view(stored).first().top_now[:1] == [snap["all"].top_skills[0].skill]
    assert serving.salary_view(stored, "ml_engineer").first().salary_sample_size == 1
    bad = spark.createDataFrame([({"a": 0.9}, {"b": 0.9}, {"c": 0.1}), ({"a": 0.2}, {"b": 0.9}, {"c": 0.1})], "health map<string,double>, batch map<string,double>, drift map<string,double>")
    gated = dataflow.weekly(raw, empty(JOBS), empty(SKILLS), empty(SEEN), F.lit(NOW), "2024-01-01", sinks, checks=bad)
    assert not gated.passed and gated.steps["checked"] == {"checks": 2, "failed": 1} and "analysed" not in gated.steps
    assert dataflow.weekly(raw, empty(JOBS), empty(SKILLS), empty(SEEN), F.lit(NOW), "2024-01-01", {**sinks, **more}, checks=bad.limit(1)).passed
    assert {r.skill for r in kept["trends"]} >= {"PyTorch"} and kept["salaries"] and set(kept) >= {"cooccurrence"}
    closed = dataflow.weekly(raw.limit(0), empty(JOBS), empty(SKILLS), empty(SEEN), F.lit(NOW), "2024-01-01", sinks)
    assert not closed.passed and "analysed" not in closed.steps


def test_views(spark):
    snaps = spark.createDataFrame([("2024-01-01", "all", 1), ("2024-01-08", "all", 2), ("2024-01-01", "ml_engineer", 3)], "week_start string, role_category string, n int").withColumn("week_start", F.to_date("week_start"))
    assert serving.snapshot_view(snaps).first().n == 2 and serving.snapshot_view(snaps, "2024-01-01").first().n == 1
    assert serving.skills_view(snaps, "ml_engineer").first().n == 3 and serving.skills_view(snaps, "nobody").first().n == 2
    assert serving.snapshot_view(snaps, "2023-01-02").count() == 0
