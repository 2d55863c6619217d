"""Dataflow of the weekly run: ingest, enrich, analyse, check, with routes decided on one-row aggregates.

Stages are functions of DataFrames; only the sinks act. A failing stage fails the run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.columns import dedup_hash
from tidemark.functions.skills import extract as extract_skills
from tidemark.functions.vocabulary import IMPLIED
from tidemark.operators import cubes, market, quality, stores
from tidemark.sources.schemas import conform
from tidemark.tables import drop_table, write_table


def prepare(raw: DataFrame, now) -> DataFrame:
    """Postings with hash, role, level, pay and flags from their texts."""
    pay = t.extract_salary(F.col("description"))
    return raw.withColumns(
        {
            "dedup_hash": dedup_hash(F.col("title"), F.col("company"), F.col("location")), "role_category": t.classify_role(F.col("title")), "experience_level": t.classify_level(F.col("title")),
            "salary_min": pay["low"], "salary_max": pay["high"], "offers_sponsorship": t.offers_sponsorship(F.col("description")), "citizens_only": t.citizens_only(F.col("description")),
            "is_startup": t.is_startup(F.col("description")), "scraped_at": now,
        }
    )


def ingest(raw: DataFrame, jobs: DataFrame, seen: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New postings; the jobs store with them added and known ones touched; the seen store with the admitted ones marked."""
    ready = prepare(raw, now)
    new = stores.filter_new(ready, seen, now, [F.col("job_id")])
    merged = stores.upsert_first_wins(jobs, new.select(*jobs.columns), "job_id", ("scraped_at", "dedup_hash"))
    known = ready.join(jobs.select("dedup_hash").distinct(), "dedup_hash", "left_semi")
    return new, stores.touch(merged, known, "dedup_hash", "scraped_at", now), stores.mark_seen(seen, new, now)


def enrich(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills of postings that have none: those in the text, and those of the role where the text is short or names none."""
    bare = market.unenriched(jobs, skills)
    found = extract_skills(bare, "job_id", "description")
    have = found.select("job_id").distinct().withColumn("_has", F.lit(True))
    thin = bare.join(have, "job_id", "left").filter((F.length(F.trim(F.coalesce("description", F.lit("")))) < 150) | F.col("_has").isNull())
    return found.unionByName(market.implied(thin, found, IMPLIED))


def analyse(jobs: DataFrame, skills: DataFrame, week: str, now=None) -> DataFrame:
    """The week's snapshot out of the cells of its two weeks, which postings and skills are read for once."""
    weeks = market.in_week(week) | market.in_week(week, 1)
    cells = write_table(cubes.cells(jobs.filter(weeks), skills, ("postings", "skills")), "cells")
    snapshot = write_table(quality.snapshot_quality(cubes.snapshot(cells, week, now=now)), "snapshot")
    drop_table(cells)
    return snapshot


@dataclass
class Run:
    """A run's record: what each step said, and whether the gate let it go on."""

    steps: dict = field(default_factory=dict)
    passed: bool = True

    def step(self, name: str, rows: DataFrame, good: Callable[[dict], bool]) -> dict:
        """One one-row aggregate decides the route."""
        said = rows.first().asDict()
        self.steps[name] = said
        self.passed = self.passed and bool(good(said))
        return said


#: Stores that the analysis fills, where their sinks are given.
HISTORIES = ("cooccurrence", "salaries", "trends")


def histories(jobs: DataFrame, skills: DataFrame, snapshot: DataFrame, week: str, now) -> dict[str, DataFrame]:
    """Rows of the week for the stores of pairs, pay by role and shares by skill, each in its table's schema."""
    when, at = market.in_week(week), F.lit(week).cast("date")
    pairs = market.cooccurrence(jobs, skills, when).select("skill_a", "skill_b", F.col("pmi").alias("pmi_score"), "co_count", at.alias("week"))
    pay = snapshot.filter("salary_sample_size > 0").withColumn("sample_size", F.col("salary_sample_size"))
    named = market.demand(jobs, skills, when).crossJoin(F.broadcast(jobs.filter(when).agg(F.count("*").alias("total"))))  # one row
    shares = stores.trends(named, F.col("total")).select(at.alias("week_start"), "skill", F.col("mentions").alias("job_count"), "pct_of_jobs", now.alias("computed_at"))
    return {"cooccurrence": conform(pairs, "skill_cooccurrence"), "salaries": conform(pay, "salary_history"), "trends": conform(shares, "skill_trends")}


def weekly(
    raw: DataFrame, jobs: DataFrame, skills: DataFrame, seen: DataFrame, now, week: str, sinks: dict[str, Callable[[DataFrame], None]], least: int = 1, checks: DataFrame | None = None
) -> Run:
    """Ingest, gate, enrich, analyse. Sinks: jobs, seen, skills, snapshot, and those of HISTORIES that are given.

    What came in is stored whatever the gates say; nothing is after a closed one. checks (maps health, batch, drift, of
    one row or more): the quality gate, which has to pass for all rows before anything is analysed. Each step's result
    is written once and read from there, so no sink can change what a later step reads; what was written goes with the run's end.
    """
    run, held = Run(), []
    try:
        return _weekly(run, held, raw, jobs, skills, seen, now, week, sinks, least, checks)
    finally:
        drop_table(*held)


def _weekly(run: Run, held: list, raw, jobs, skills, seen, now, week: str, sinks, least: int, checks) -> Run:
    def written(df: DataFrame, name: str) -> DataFrame:
        held.append(write_table(df, name))
        return held[-1]

    new, jobs_now, seen_now = (written(df, name) for df, name in zip(ingest(raw, jobs, seen, now), ("new", "jobs", "seen")))
    run.step("collected", new.agg(F.count("*").alias("new"), F.countDistinct("source").alias("sources")), lambda s: s["new"] >= least)
    skills = written(skills, "skills")
    sinks["jobs"](jobs_now)
    sinks["seen"](seen_now)
    if run.passed and checks is not None:
        run.step("checked", quality.gate(checks, "health", "batch", "drift").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed")), lambda s: s["failed"] == 0)
    if not run.passed:
        return run
    more = written(enrich(jobs_now, skills), "enriched")
    sinks["skills"](more)
    every = skills.unionByName(more.select(*skills.columns))
    snapshot = analyse(jobs_now, every, week, now)
    held.append(snapshot)
    run.step("analysed", snapshot.agg(F.count("*").alias("roles"), F.count_if(F.col("quality") == "poor").alias("poor")), lambda s: s["roles"] > 0)
    sinks["snapshot"](snapshot)
    wanted = [name for name in HISTORIES if name in sinks]
    for name, rows in histories(jobs_now, every, snapshot, week, now).items() if wanted else ():
        if name in wanted:
            sinks[name](rows)
    return run
