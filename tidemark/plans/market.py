"""Market aggregates over the bound driver tables, each with its oracle."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tidemark.operators import cubes
from tidemark.operators import market as m
from tidemark.sources.binding import CTE, WEEK, job_skills, jobs
from tidemark.sources.landed import fan_in
from tidemark.sources.schemas import conform
from tidemark.tables import shared_dir, write_table

#: The weeks before WEEK and the one after.
EARLIER, BEFORE, AFTER = "1998-05-18", "1998-05-25", "1998-06-08"
#: Places by which the driver's nations are told apart: the exact name first, then the first pattern contained.
PLACES = (("nation_1", "North"), ("nation_10", "Capital"), ("nation_2", "South"), ("nation_3", "East"), ("nation_4", "West"))
#: Stacks over the driver's brands; contained either way round.
STACKS = {"Alpha": ("brand#1", "brand#22x", "brand#3"), "Beta": ("brand#4", "brand#5"), "Gamma": ("none", "brand#25")}

_WEEK = f"TIMESTAMP '{WEEK}'"
_IN = f"scraped_at >= {_WEEK} AND scraped_at < {_WEEK} + INTERVAL 7 DAY"
_PREV = f"scraped_at >= {_WEEK} - INTERVAL 7 DAY AND scraped_at < {_WEEK}"
_PAY = "(salary_min IS NOT NULL OR salary_max IS NOT NULL) AND salary_min > 10000 AND (salary_max IS NULL OR salary_max < 600000)"
_MID = "CASE WHEN salary_min <> 0 AND salary_max <> 0 THEN (salary_min + salary_max) / 2 ELSE coalesce(nullif(salary_max, 0), salary_min) END"
_RANK = "list_sort(list(mid))[greatest(1, (count(*) * {p}) // 100)]"


def _with(sql: str) -> str:
    return f"WITH {CTE} {sql}"


def _pct(p: int, where: str = "count(*) >= 5") -> str:
    return f"CASE WHEN {where} THEN round({_RANK.format(p=p)}, 0) END AS p{p}"


def skill_demand(spark, sf):
    when = (F.col("scraped_at") >= m.ts("1998-01-01")) & (F.col("scraped_at") < m.ts("1998-07-01"))
    return m.top(m.demand(jobs(spark, sf), job_skills(spark, sf), when), "mentions", "skill", 50)


def skill_prior_counts(spark, sf):
    return m.demand(jobs(spark, sf), job_skills(spark, sf), m.in_week(WEEK, 1))


def skills_by_role(spark, sf):
    named = jobs(spark, sf).filter("role_category is not null and role_category <> 'other'")
    recent = named.filter(F.col("scraped_at") >= m.ts(WEEK))
    counts = job_skills(spark, sf).join(recent, "job_id").groupBy("role_category", "skill").agg(F.count("*").alias("mentions"))
    return m.top_per(counts, "role_category", "mentions", "skill", 50)


def skill_demand_fallback(spark, sf):
    """A week without postings: the 30 days before it step in."""
    j, s, empty = jobs(spark, sf), job_skills(spark, sf), "2001-08-20"
    first = m.demand(j, s, m.in_week(empty))
    second = m.demand(j, s, (F.col("scraped_at") >= m.shifted(empty, -30)) & (F.col("scraped_at") < m.shifted(empty, 7)))
    return m.with_fallback(first, second, [F.desc("mentions"), F.col("skill")], 50)


def skill_movers(spark, sf):
    return m.movers(jobs(spark, sf), job_skills(spark, sf), WEEK)


def skill_anomalies(spark, sf):
    return m.anomalies(jobs(spark, sf), job_skills(spark, sf), WEEK, 3)


def rank_churn(spark, sf):
    return m.churn(jobs(spark, sf), job_skills(spark, sf), WEEK)


def salary_percentiles(spark, sf):
    return m.percentiles(m.salaries(jobs(spark, sf)).filter(F.col("mid").between(20000, 300000)), "mid", ("company_stage",))


def salary_ladder(spark, sf):
    return m.salary_ladder(jobs(spark, sf), WEEK)


def sponsorship_by_role_stage(spark, sf):
    return m.sponsorship_by(jobs(spark, sf))


def sponsorship_rate(spark, sf):
    return m.sponsorship_rate(jobs(spark, sf))


def hiring_momentum(spark, sf):
    return m.momentum(jobs(spark, sf), WEEK)


def expansion_signals(spark, sf):
    j = jobs(spark, sf)
    return m.expansions(j, WEEK, m.quiet_companies(j, "1998-05-25"))


def role_velocity(spark, sf):
    return m.role_velocity(jobs(spark, sf), m.in_week(WEEK))


def places(spark, sf):
    return m.places(jobs(spark, sf), F.col("scraped_at") >= m.ts(WEEK), PLACES)


def place_share(spark, sf):
    return m.place_share(jobs(spark, sf), WEEK, PLACES, "North")


def skill_pmi(spark, sf):
    when = (F.col("scraped_at") >= m.ts("1998-01-01")) & (F.col("scraped_at") < m.ts("1999-01-01"))
    return m.cooccurrence(jobs(spark, sf), job_skills(spark, sf), when)


def archetypes(spark, sf):
    return m.archetypes(jobs(spark, sf), job_skills(spark, sf), F.col("scraped_at") >= m.ts(WEEK), STACKS)


def job_count_ladder(spark, sf):
    return m.job_count_ladder(jobs(spark, sf), "2001-08-20")


def _flat(snapshot):
    """The snapshot with its lists as text."""
    pairs = lambda c, a: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x[a], x["n"].cast("string"))), ",")
    out = snapshot.withColumns({"top_skills": pairs("top_skills", "skill"), "top_cities": pairs("top_cities", "place")})
    return out.withColumns({c: F.array_join(c, ",") for c in ("rising_skills", "declining_skills")}).drop("computed_at")


def _cells(spark, sf, since: str, until: str):
    """Cells of the days from since to before until, written once."""
    days = (F.col("scraped_at") >= m.ts(since)) & (F.col("scraped_at") < m.ts(until))
    return write_table(cubes.cells(jobs(spark, sf).filter(days), job_skills(spark, sf), ("postings", "skills")), "cells")


def weekly_snapshot(spark, sf):
    return _flat(cubes.snapshot(_cells(spark, sf, BEFORE, AFTER), WEEK, 50, PLACES))


def snapshot_views(spark, sf):
    """The snapshot, trending and salary views on two weeks' snapshots in the stored schema."""
    from tidemark.plans import serving

    cells = _cells(spark, sf, EARLIER, AFTER)
    stored = write_table(fan_in([conform(cubes.snapshot(cells, w, 50, PLACES), "weekly_snapshots") for w in (BEFORE, WEEK)]), "snapshots")
    text = lambda c: F.array_join(c, ",")
    trending = serving.trending_view(stored).select("week_start", text("rising").alias("rising"), text("declining").alias("declining"), text("top_now").alias("top_now"))
    salary = serving.salary_view(stored, "data_scientist").select(*[F.col(f"salary_p{p}").alias(f"p{p}") for p in (25, 50, 75)], "salary_sample_size")
    whole = serving.snapshot_view(stored, BEFORE).select(F.col("job_count").alias("job_count_before"))
    return trending.crossJoin(salary).crossJoin(whole)  # a row each


def _maintained(spark, sf, kinds, weeks_wanted: tuple[str, str]):
    """Cells of a cube that was built and then changed: it starts without every 11th posting, which come in; every 5th but one is
    scraped again a week later; every 13th goes. Returned are the cells of the days wanted, read by day and written once."""
    j, s = jobs(spark, sf), job_skills(spark, sf)
    late = F.col("job_id") % 11 == 0
    cube = cubes.DayCube.create(f"{shared_dir(spark)}/cube-{uuid.uuid4().hex}", j.filter(~late), s, kinds, 16)
    cube.apply(cubes.changes(j.limit(0), j.filter(late), s, kinds=kinds), "postings", 0)
    again = j.filter(F.col("job_id") % 5 == 1)
    cube.apply(cubes.changes(again, again.withColumn("scraped_at", F.expr("scraped_at + interval 7 days")), s, kinds=kinds), "postings", 1)
    gone = j.filter(F.col("job_id") % 13 == 0).withColumn("scraped_at", F.when(F.col("job_id") % 5 == 1, F.expr("scraped_at + interval 7 days")).otherwise(F.col("scraped_at")))
    cube.apply(cubes.changes(gone, j.limit(0), s, kinds=kinds), "postings", 2)
    return write_table(cube.days(*weeks_wanted), "cells")


def cube_snapshot(spark, sf):
    """The snapshot out of a cube that saw inserts, postings that moved to another day, and deletions."""
    return _flat(cubes.snapshot(_maintained(spark, sf, ("postings", "skills"), (BEFORE, AFTER)), WEEK, 50, PLACES))


def cube_ladder(spark, sf):
    return cubes.salary_ladder(_maintained(spark, sf, ("postings",), ("1998-01-01", AFTER)), WEEK)


def cube_momentum(spark, sf):
    return cubes.momentum(_maintained(spark, sf, ("postings",), ("1998-05-18", AFTER)), WEEK)


def cube_velocity(spark, sf):
    return cubes.role_velocity(_maintained(spark, sf, ("postings",), (WEEK, AFTER)), WEEK, AFTER)


def cube_pmi(spark, sf):
    """Pairs of a year out of the maintained cells."""
    return cubes.cooccurrence(_maintained(spark, sf, ("pairs",), ("1998-01-01", "1999-01-01")), "1998-01-01", "1999-01-01")


def role_velocity_fallback(spark, sf):
    """A week without postings: the 30 days before it step in."""
    empty = "2001-08-20"
    since = (F.col("scraped_at") >= m.shifted(empty, -30)) & (F.col("scraped_at") < m.shifted(empty, 7))
    return m.role_velocity(jobs(spark, sf), m.in_week(empty), since)


def migration(spark, sf):
    """Archetypes that fell in share between two weeks."""
    j, s = jobs(spark, sf), job_skills(spark, sf)
    return m.migration_signals(m.archetypes(j, s, m.in_week(WEEK), STACKS), m.archetypes(j, s, m.in_week(BEFORE), STACKS), 1.0)


def skill_trends(spark, sf):
    """K5: shares by skill of the week's postings, in the stored schema."""
    from tidemark.operators import stores

    j = jobs(spark, sf)
    total = j.filter(m.in_week(WEEK)).agg(F.count("*").alias("total"))
    named = m.demand(j, job_skills(spark, sf), m.in_week(WEEK)).crossJoin(F.broadcast(total))  # one row
    rows = stores.trends(named, F.col("total")).select(F.lit(WEEK).cast("date").alias("week_start"), "skill", F.col("mentions").alias("job_count"), "pct_of_jobs")
    return conform(rows, "skill_trends").drop("computed_at")


def cooccurrence_rows(spark, sf):
    """K7: the week's pairs in the stored schema."""
    pairs = m.cooccurrence(jobs(spark, sf), job_skills(spark, sf), m.in_week(WEEK) | m.in_week(WEEK, 1), least=2)
    return conform(pairs.select("skill_a", "skill_b", F.col("pmi").alias("pmi_score"), "co_count", F.lit(WEEK).cast("date").alias("week")), "skill_cooccurrence")


def source_counts(spark, sf):
    j = jobs(spark, sf)
    copies = F.countDistinct(F.struct("company", F.coalesce("role_category", F.lit("")), "location"))
    return j.groupBy("source").agg(F.count("*").alias("raw"), F.countDistinct("company").alias("companies"), copies.alias("deduped"))


def startup_ratio(spark, sf):
    return jobs(spark, sf).groupBy("source").agg(F.round(F.avg(F.col("is_startup").cast("double")), 6).alias("startup_ratio"))


def trends_history(spark, sf):
    """Weekly share of postings by skill category with the change against the week before."""
    from pyspark.sql import Window

    j = jobs(spark, sf).filter((F.col("scraped_at") >= m.ts("1998-01-05")) & (F.col("scraped_at") < m.ts("1998-03-30")))
    weekly = F.date_trunc("week", F.col("scraped_at")).cast("date").alias("week_start")
    named = job_skills(spark, sf).join(j, "job_id").groupBy(weekly, "skill_category").agg(F.countDistinct("job_id").alias("n"))
    total = j.groupBy(weekly).agg(F.count("*").alias("total"))
    before = F.lag("pct_of_jobs").over(Window.partitionBy("skill_category").orderBy("week_start"))
    shared = named.join(total, "week_start").select("week_start", "skill_category", F.round(F.col("n") / F.col("total"), 6).alias("pct_of_jobs"))
    return shared.withColumn("delta", F.round(F.col("pct_of_jobs") - before, 6))


def salary_history(spark, sf):
    pay = m.salaries(jobs(spark, sf)).withColumn("week_start", F.date_trunc("week", F.col("scraped_at")).cast("date"))
    return m.percentiles(pay.filter(F.col("mid").between(20000, 300000)), "mid", ("week_start", "location"), (25, 50, 75), 1)


def rollup_roles(spark, sf):
    j = jobs(spark, sf).withColumn("role", F.coalesce("role_category", F.lit("other")))
    return j.rollup("role").agg(F.count("*").alias("postings"), F.grouping("role").cast("int").alias("whole"))


_ROLES_WITH = "role_category IS NOT NULL AND role_category <> 'other'"
QUERIES = {
    f.__name__: f
    for f in (
        skill_demand, skill_prior_counts, skills_by_role, skill_demand_fallback, skill_movers, skill_anomalies, rank_churn, salary_percentiles, salary_ladder,
        sponsorship_by_role_stage, sponsorship_rate, hiring_momentum, expansion_signals, role_velocity, places, place_share, skill_pmi, archetypes, job_count_ladder,
        weekly_snapshot, snapshot_views, cube_snapshot, cube_ladder, cube_momentum, cube_velocity, cube_pmi, role_velocity_fallback, migration, skill_trends, cooccurrence_rows, source_counts, startup_ratio, trends_history, salary_history, rollup_roles,
    )
}

_W = f"""w AS (SELECT skill, count(*) FILTER ({_IN}) AS w0, count(*) FILTER ({_PREV}) AS w1 FROM job_skills JOIN jobs USING (job_id)
    WHERE scraped_at >= {_WEEK} - INTERVAL 7 DAY AND scraped_at < {_WEEK} + INTERVAL 7 DAY GROUP BY 1)"""
_LADDER = f"""near AS (SELECT *, {_MID} AS mid, ({_PAY}) AS ok, CASE WHEN scraped_at >= {_WEEK} THEN 0 WHEN scraped_at >= {_WEEK} + INTERVAL 7 DAY - INTERVAL 30 DAY THEN 1 ELSE 2 END AS step
    FROM jobs WHERE scraped_at < {_WEEK} + INTERVAL 7 DAY AND scraped_at >= {_WEEK} + INTERVAL 7 DAY - INTERVAL 90 DAY),
    c AS (SELECT CASE WHEN count(*) FILTER (ok AND step <= 0) >= 5 THEN 0 WHEN count(*) FILTER (ok AND step <= 1) >= 5 THEN 1 ELSE 2 END AS chosen FROM near)"""
_PLACE = "CASE WHEN location = '' OR location IS NULL THEN NULL " + " ".join(f"WHEN location = '{p}' THEN '{n}'" for p, n in PLACES) + " " + " ".join(f"WHEN contains(location, '{p}') THEN '{n}'" for p, n in PLACES) + " ELSE 'Other' END"
_STACK_ROWS = ", ".join(f"('{a}', {n}, '{w}')" for a, ws in STACKS.items() for n, w in enumerate(ws))



def _snapshot(week: str, tag: str = "") -> str:
    """Common table expressions up to snap: the flat snapshot of a week."""
    at = f"TIMESTAMP '{week}'"
    inside = f"scraped_at >= {at} AND scraped_at < {at} + INTERVAL 7 DAY"
    before = f"scraped_at >= {at} - INTERVAL 7 DAY AND scraped_at < {at}"
    rate = lambda c, name: f"round(count(*) FILTER ({c})::DOUBLE / count(*), 4) AS {name}"
    pays = ", ".join(_pct(p).replace(f"AS p{p}", f"AS salary_p{p}") for p in m.PERCENTS)
    sql = f"""two AS (SELECT *, coalesce(role_category, 'other') AS role, {_MID} AS mid, ({_PAY}) AS ok, ({inside}) AS cur FROM jobs WHERE ({inside}) OR ({before})),
        b AS (SELECT role AS g, * FROM two UNION ALL SELECT 'all' AS g, * FROM two),
        f AS (SELECT g, count(*) AS job_count, count(*) AS new_job_count, {rate("offers_sponsorship", "sponsorship_rate")}, {rate("work_model = 'remote'", "remote_rate")}, {rate("work_model = 'hybrid'", "hybrid_rate")}, {rate("is_startup", "startup_rate")} FROM b WHERE cur GROUP BY 1),
        n AS (SELECT g, skill, count(*) FILTER (cur) AS n, count(*) FILTER (NOT cur) AS o FROM b JOIN job_skills USING (job_id) GROUP BY 1, 2 HAVING count(*) FILTER (cur) > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, skill) AS r, CASE WHEN o > 0 THEN (n - o)::DOUBLE / o END AS c FROM n),
        s AS (SELECT g, sum(n)::BIGINT AS skill_mentions, array_to_string(list(skill || '=' || n ORDER BY r) FILTER (r <= 50), ',') AS top_skills,
            coalesce(array_to_string((list(skill ORDER BY r) FILTER (r <= 50 AND (c > 0.5 OR (o = 0 AND n > 5))))[1:20], ','), '') AS rising_skills,
            coalesce(array_to_string((list(skill ORDER BY r) FILTER (r <= 50 AND c < -0.3))[1:20], ','), '') AS declining_skills FROM r GROUP BY 1),
        q AS (SELECT g, {_PLACE} AS place, count(*) AS n FROM b WHERE cur GROUP BY 1, 2), v AS (SELECT g, array_to_string(list(place || '=' || n ORDER BY n DESC, place), ',') AS top_cities FROM q WHERE place IS NOT NULL GROUP BY 1),
        p AS (SELECT g, count(*) AS salary_sample_size, {pays} FROM b WHERE cur AND ok AND mid BETWEEN 20000 AND 300000 GROUP BY 1),
        snap AS (SELECT g AS role_category, * EXCLUDE (g, salary_sample_size), coalesce(salary_sample_size, 0) AS salary_sample_size, round(coalesce(salary_sample_size, 0)::DOUBLE / job_count, 3) AS disclosure_rate, DATE '{week}' AS week_start
            FROM f LEFT JOIN s USING (g) LEFT JOIN v USING (g) LEFT JOIN p USING (g))"""
    for name in ("two", "b", "f", "n", "r", "s", "q", "v", "p", "snap") if tag else ():
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{tag}", re.sub(rf"(?<![\w.]){name} AS \(", f"{name}{tag} AS (", sql))
    return sql


def _stacks(when: str, tag: str) -> str:
    """Common table expressions up to a: the archetypes' shares in a window."""
    return f"""f{tag} AS (SELECT skill, count(*) AS mentions FROM job_skills JOIN jobs USING (job_id) WHERE {when} GROUP BY 1 ORDER BY mentions DESC, skill LIMIT 50),
        k{tag}(archetype, n, word) AS (VALUES {_STACK_ROWS}),
        h{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archetype, n ORDER BY mentions DESC, skill) AS r FROM k{tag} JOIN f{tag} ON contains(skill, word) OR contains(word, skill)) WHERE r = 1),
        a{tag} AS (SELECT archetype, round(coalesce(sum(mentions), 0)::DOUBLE / (SELECT sum(mentions) FROM f{tag}), 4) AS demand_share FROM (SELECT DISTINCT archetype FROM k{tag}) LEFT JOIN h{tag} USING (archetype) GROUP BY 1)"""


#: The postings as the maintained cube has them after its changes.
_CHANGED = "WITH " + CTE.replace("jobs AS (SELECT", "before AS (SELECT", 1) + """, jobs AS (SELECT * REPLACE (CASE WHEN job_id % 5 = 1 THEN scraped_at + INTERVAL 7 DAY ELSE scraped_at END AS scraped_at) FROM before WHERE job_id % 13 <> 0)"""
ORACLES = {
    "skill_demand": _with("SELECT skill, count(*) AS mentions FROM job_skills JOIN jobs USING (job_id) WHERE scraped_at >= TIMESTAMP '1998-01-01' AND scraped_at < TIMESTAMP '1998-07-01' GROUP BY 1 ORDER BY mentions DESC, skill LIMIT 50"),
    "skill_prior_counts": _with(f"SELECT skill, count(*) AS mentions FROM job_skills JOIN jobs USING (job_id) WHERE {_PREV} GROUP BY 1"),
    "skills_by_role": _with(f"""SELECT * FROM (SELECT role_category, skill, count(*) AS mentions, row_number() OVER (PARTITION BY role_category ORDER BY count(*) DESC, skill)::INT AS rank
        FROM job_skills JOIN jobs USING (job_id) WHERE {_ROLES_WITH} AND scraped_at >= {_WEEK} GROUP BY 1, 2) WHERE rank <= 50"""),
    "skill_demand_fallback": _with("""SELECT skill, count(*) AS mentions FROM job_skills JOIN jobs USING (job_id) WHERE scraped_at >= TIMESTAMP '2001-08-20' - INTERVAL 30 DAY AND scraped_at < TIMESTAMP '2001-08-27'
        GROUP BY 1 ORDER BY mentions DESC, skill LIMIT 50"""),
    "skill_movers": _with(f""", {_W}, t AS (SELECT * FROM w WHERE w0 > 0 ORDER BY w0 DESC, skill LIMIT 50),
        d AS (SELECT *, CASE WHEN w1 > 0 AND (w0 - w1)::DOUBLE / w1 > 0.5 THEN 'rising' WHEN w1 > 0 AND (w0 - w1)::DOUBLE / w1 < -0.3 THEN 'declining' WHEN w1 = 0 AND w0 > 5 THEN 'rising' END AS direction FROM t)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY w0 DESC, skill)::INT AS rank FROM d WHERE direction IS NOT NULL) WHERE rank <= 20"""),
    "skill_anomalies": _with(f", {_W} SELECT * FROM w WHERE w1 > 0 AND w0 > 3 * w1"),
    "rank_churn": _with(f""", {_W}, a AS (SELECT skill FROM w WHERE w0 > 0 ORDER BY w0 DESC, skill LIMIT 10), b AS (SELECT skill FROM w WHERE w1 > 0 ORDER BY w1 DESC, skill LIMIT 10)
        SELECT count(*)::INT AS new_in_top, count(*) <= 3 AS stable FROM a WHERE skill NOT IN (SELECT skill FROM b)"""),
    "salary_percentiles": _with(f", p AS (SELECT company_stage, {_MID} AS mid FROM jobs WHERE {_PAY}) SELECT company_stage, count(*) AS sample_size, {', '.join(map(_pct, m.PERCENTS))} FROM p WHERE mid BETWEEN 20000 AND 300000 GROUP BY 1"),
    "salary_ladder": _with(f""", {_LADDER}, u AS (SELECT mid FROM near, c WHERE ok AND step <= chosen AND mid BETWEEN 20000 AND 300000)
        SELECT {', '.join(map(_pct, m.PERCENTS))}, count(*) AS sample_size, round(count(*)::DOUBLE / greatest((SELECT count(*) FROM near, c WHERE step <= chosen), 1), 3) AS disclosure_rate,
        (SELECT [7, 30, 90][chosen + 1] FROM c) AS window_days FROM u"""),
    "sponsorship_by_role_stage": _with("""SELECT coalesce(role_category, 'unknown') AS role_category, company_stage, count(*) AS postings, count(*) FILTER (offers_sponsorship) AS offering,
        round(count(*) FILTER (offers_sponsorship)::DOUBLE / count(*), 3) AS rate FROM jobs WHERE offers_sponsorship IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10"""),
    "sponsorship_rate": _with("SELECT count(*) AS postings, round(count(*) FILTER (offers_sponsorship)::DOUBLE / count(*), 3) AS rate FROM jobs"),
    "hiring_momentum": _with(f""", c AS (SELECT company, count(*) FILTER ({_IN}) AS w0, count(*) FILTER ({_PREV}) AS w1,
        count(*) FILTER (scraped_at >= {_WEEK} - INTERVAL 14 DAY AND scraped_at < {_WEEK} - INTERVAL 7 DAY) AS w2 FROM jobs WHERE scraped_at >= {_WEEK} - INTERVAL 14 DAY AND scraped_at < {_WEEK} + INTERVAL 7 DAY GROUP BY 1)
        SELECT *, round(w0 * 1.0::DOUBLE + w1 * 0.6::DOUBLE + w2 * 0.3::DOUBLE, 2) AS momentum FROM c WHERE w0 + w1 + w2 > 0 ORDER BY momentum DESC, company LIMIT 20"""),
    "expansion_signals": _with(f"""SELECT company, count(*) AS w0 FROM jobs WHERE {_IN} AND company IN (SELECT company FROM jobs WHERE scraped_at >= TIMESTAMP '1998-05-04' AND scraped_at < TIMESTAMP '1998-06-01'
        GROUP BY 1 HAVING count(*) FILTER (scraped_at >= TIMESTAMP '1998-05-25') = 0) GROUP BY 1"""),
    "role_velocity": _with(f"SELECT coalesce(role_category, 'other') AS role, count(*) AS postings FROM jobs WHERE {_IN} GROUP BY 1"),
    "places": _with(f"SELECT {_PLACE} AS place, count(*) AS postings FROM jobs WHERE scraped_at >= {_WEEK} AND location <> '' GROUP BY 1 ORDER BY postings DESC, place LIMIT 20"),
    "place_share": _with(f""", s AS (SELECT round(count(*) FILTER ({_IN} AND {_PLACE} = 'North')::DOUBLE / count(*) FILTER ({_IN}), 4) AS share,
        round(count(*) FILTER ({_PREV} AND {_PLACE} = 'North')::DOUBLE / count(*) FILTER ({_PREV}), 4) AS before FROM jobs WHERE location <> '')
        SELECT share, before, abs(share - before) > 0.10 AS shifted, share < 0.2 AS low FROM s"""),
    "skill_pmi": _with(""", d AS (SELECT DISTINCT job_id, skill FROM job_skills JOIN jobs USING (job_id) WHERE scraped_at >= TIMESTAMP '1998-01-01' AND scraped_at < TIMESTAMP '1999-01-01'),
        n AS (SELECT skill, count(*) AS n FROM d GROUP BY 1), t AS (SELECT count(DISTINCT job_id) AS total FROM d),
        p AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS co_count FROM d a JOIN d b ON a.job_id = b.job_id AND a.skill < b.skill GROUP BY 1, 2 HAVING count(*) >= 3),
        s AS (SELECT skill_a, skill_b, round(ln(co_count::DOUBLE * total / (na.n::DOUBLE * nb.n)), 4) AS pmi, co_count FROM p JOIN n na ON na.skill = skill_a JOIN n nb ON nb.skill = skill_b, t)
        SELECT * FROM s WHERE pmi > 0 ORDER BY pmi DESC, co_count DESC, skill_a, skill_b LIMIT 200"""),
    "archetypes": _with(f""", f AS (SELECT skill, count(*) AS mentions FROM job_skills JOIN jobs USING (job_id) WHERE scraped_at >= {_WEEK} GROUP BY 1 ORDER BY mentions DESC, skill LIMIT 50),
        k(archetype, n, word) AS (VALUES {_STACK_ROWS}),
        h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archetype, n ORDER BY mentions DESC, skill) AS r FROM k JOIN f ON contains(skill, word) OR contains(word, skill)) WHERE r = 1)
        SELECT a.archetype, round(coalesce(sum(mentions), 0)::DOUBLE / (SELECT sum(mentions) FROM f), 4) AS demand_share, count(skill) AS skill_count,
        array_to_string(list(skill ORDER BY n) FILTER (skill IS NOT NULL), ',') AS dominant_skills FROM (SELECT DISTINCT archetype FROM k) a LEFT JOIN h USING (archetype) GROUP BY 1"""),
    "job_count_ladder": _with("""SELECT coalesce(nullif(count(*) FILTER (scraped_at >= TIMESTAMP '2001-08-20' AND scraped_at < TIMESTAMP '2001-08-27'), 0),
        nullif(count(*) FILTER (scraped_at >= TIMESTAMP '2001-08-27' - INTERVAL 30 DAY AND scraped_at < TIMESTAMP '2001-08-27'), 0),
        nullif(count(*) FILTER (scraped_at >= TIMESTAMP '2001-08-27' - INTERVAL 90 DAY AND scraped_at < TIMESTAMP '2001-08-27'), 0), count(*)) AS job_count FROM jobs"""),
    "weekly_snapshot": _with(f", {_snapshot(WEEK)} SELECT * FROM snap"),
    "snapshot_views": _with(f""", {_snapshot(WEEK)}, {_snapshot(BEFORE, "_b")} SELECT a.week_start, a.rising_skills AS rising, a.declining_skills AS declining,
        array_to_string(list_transform(string_split(a.top_skills, ',')[1:10], lambda x: string_split(x, '=')[1]), ',') AS top_now,
        s.salary_p25 AS p25, s.salary_p50 AS p50, s.salary_p75 AS p75, s.salary_sample_size, b.job_count AS job_count_before FROM snap a, snap s, snap_b b WHERE a.role_category = 'all' AND s.role_category = 'data_scientist' AND b.role_category = 'all'"""),
    "role_velocity_fallback": _with("SELECT coalesce(role_category, 'other') AS role, count(*) AS postings FROM jobs WHERE scraped_at >= TIMESTAMP '2001-08-20' - INTERVAL 30 DAY AND scraped_at < TIMESTAMP '2001-08-27' GROUP BY 1"),
    "migration": _with(f""", {_stacks(_IN, "")}, {_stacks(_PREV, "_b")} SELECT a.archetype, b.demand_share AS before, a.demand_share FROM a JOIN a_b b USING (archetype) WHERE b.demand_share > 0 AND a.demand_share < b.demand_share"""),
    "skill_trends": _with(f"""SELECT DATE '{WEEK}' AS week_start, skill, count(*) AS job_count, round(count(*)::DOUBLE / (SELECT count(*) FROM jobs WHERE {_IN}), 6) AS pct_of_jobs, 'all' AS role_category
        FROM job_skills JOIN jobs USING (job_id) WHERE {_IN} GROUP BY skill"""),
    "cooccurrence_rows": _with(f""", d AS (SELECT DISTINCT job_id, skill FROM job_skills JOIN jobs USING (job_id) WHERE ({_IN}) OR ({_PREV})),
        n AS (SELECT skill, count(*) AS n FROM d GROUP BY 1), t AS (SELECT count(DISTINCT job_id) AS total FROM d),
        p AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS co_count FROM d a JOIN d b ON a.job_id = b.job_id AND a.skill < b.skill GROUP BY 1, 2 HAVING count(*) >= 2),
        s AS (SELECT skill_a, skill_b, round(ln(co_count::DOUBLE * total / (na.n::DOUBLE * nb.n)), 4) AS pmi_score, co_count, DATE '{WEEK}' AS week FROM p JOIN n na ON na.skill = skill_a JOIN n nb ON nb.skill = skill_b, t)
        SELECT * FROM s WHERE pmi_score > 0 ORDER BY pmi_score DESC, co_count DESC, skill_a, skill_b LIMIT 200"""),
    "source_counts": _with("SELECT source, count(*) AS raw, count(DISTINCT company) AS companies, count(DISTINCT (company, coalesce(role_category, ''), location)) AS deduped FROM jobs GROUP BY 1"),
    "startup_ratio": _with("SELECT source, round(avg(is_startup::INT::DOUBLE), 6) AS startup_ratio FROM jobs GROUP BY 1"),
    "trends_history": _with(""", j AS (SELECT *, date_trunc('week', scraped_at)::DATE AS week_start FROM jobs WHERE scraped_at >= TIMESTAMP '1998-01-05' AND scraped_at < TIMESTAMP '1998-03-30'),
        t AS (SELECT week_start, count(*) AS total FROM j GROUP BY 1), s AS (SELECT week_start, skill_category, count(DISTINCT job_id) AS n FROM j JOIN job_skills USING (job_id) GROUP BY 1, 2),
        p AS (SELECT week_start, skill_category, round(n::DOUBLE / total, 6) AS pct_of_jobs FROM s JOIN t USING (week_start))
        SELECT *, round(pct_of_jobs - lag(pct_of_jobs) OVER (PARTITION BY skill_category ORDER BY week_start), 6) AS delta FROM p"""),
    "salary_history": _with(f""", p AS (SELECT date_trunc('week', scraped_at)::DATE AS week_start, location, {_MID} AS mid FROM jobs WHERE {_PAY})
        SELECT week_start, location, count(*) AS sample_size, {', '.join(_pct(p, 'true') for p in (25, 50, 75))} FROM p WHERE mid BETWEEN 20000 AND 300000 GROUP BY 1, 2"""),
    "rollup_roles": _with("SELECT role, count(*) AS postings, grouping(role)::INT AS whole FROM (SELECT coalesce(role_category, 'other') AS role FROM jobs) GROUP BY ROLLUP (role)"),
}
ORACLES |= {f"cube_{name}": ORACLES[of].replace(_with(""), _CHANGED, 1) for name, of in (("snapshot", "weekly_snapshot"), ("ladder", "salary_ladder"), ("momentum", "hiring_momentum"), ("velocity", "role_velocity"), ("pmi", "skill_pmi"))}
