"""The read views: snapshots, skills with fallback, pay, trending, job pages, health, gaps, fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vocabulary import IMPLIED
from tidemark.operators import market as m
from tidemark.operators import similarity
from tidemark.operators.clustered import Clustered
from tidemark.sources.binding import CTE, WEEK, job_skills, jobs
from tidemark.sources.tables import table


def snapshot_view(snapshots: DataFrame, week: str | None = None, role: str = "all") -> DataFrame:
    """The given week's or the latest snapshot of a role; no row where there is none."""
    rows = snapshots.filter(F.col("role_category") == role)
    if week is not None:
        return rows.filter(F.col("week_start") == F.lit(week).cast("date"))
    return rows.orderBy(F.desc("week_start")).limit(1)


def skills_view(snapshots: DataFrame, role: str) -> DataFrame:
    """The latest snapshot of the role, else of all roles."""
    wanted = snapshots.filter(F.col("role_category").isin(role, "all"))
    return wanted.orderBy((F.col("role_category") != role).cast("int"), F.desc("week_start")).limit(1)


def trending_view(snapshots: DataFrame, k: int = 10) -> DataFrame:
    latest = snapshot_view(snapshots)
    now = F.transform(F.slice("top_skills", 1, k), lambda x: x["skill"])
    return latest.select("week_start", F.col("rising_skills").alias("rising"), F.col("declining_skills").alias("declining"), now.alias("top_now"))


def salary_view(snapshots: DataFrame, role: str = "all") -> DataFrame:
    """Pay of the role's latest snapshot; no row where there is none."""
    return snapshot_view(snapshots, role=role).select("role_category", "week_start", "salary_p25", "salary_p50", "salary_p75", "salary_sample_size")


def health(log: DataFrame, now, hours: float = 72.0) -> DataFrame:
    """Last completion, rows, hours since it rounded to 1 place, and healthy below `hours`."""
    age = F.round((F.unix_micros(F.to_timestamp(now)) - F.unix_micros(F.to_timestamp(F.max("completed_at")))) / 3.6e9, 1)
    return log.agg(F.max("completed_at").alias("last_run"), F.count("*").alias("rows"), age.alias("hours")).withColumn("status", F.when(F.col("hours") < hours, "healthy").otherwise("stale"))


def newest_sample(jobs_: DataFrame, role: str, k: int = 300, least: int = 20, fallback: int = 200) -> DataFrame:
    """The k newest postings of a role; below `least` of them, the newest over all roles."""
    ranked = jobs_.withColumn("own", (F.col("role_category") == role).cast("int"))
    mine = ranked.filter("own = 1").orderBy(F.desc("scraped_at"), "job_id").limit(k)
    every = ranked.orderBy(F.desc("scraped_at"), "job_id").limit(fallback)
    count = mine.agg(F.count("*").alias("mine"))
    both = mine.withColumn("_own", F.lit(True)).unionByName(every.withColumn("_own", F.lit(False)))
    return both.crossJoin(F.broadcast(count)).filter(F.col("_own") == (F.col("mine") >= least)).drop("_own", "mine", "own")  # one row is broadcast


def career(spark, skills: tuple[str, ...], role: str, similarities: DataFrame, ranked: DataFrame, sectors: dict, snapshots: DataFrame, k: int = 5) -> DataFrame:
    """One row for a profile: market match, the first k missing skills, the three best sectors, pay of the role's latest snapshot."""
    have = spark.createDataFrame([(s,) for s in skills], "skill string")
    match = similarity.match_histogram(similarities, "similarity").withColumn("match_pct", F.round("match_pct", 1))
    gaps = m.gaps(ranked, have, k).agg(F.array_sort(F.collect_list(F.struct("priority", "skill", "importance"))).alias("gaps"))
    fit = m.sector_fit_exact(spark.createDataFrame([(1, list(skills))], "id int, skills array<string>"), sectors)
    place = F.array_position(F.array(*map(F.lit, sectors)), F.col("sector"))
    best = fit.orderBy(F.desc("fit_score"), place).limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("fit_score")).alias("o"), place.alias("p"), "sector", "fit_score"))).alias("sectors"))
    return match.crossJoin(gaps).crossJoin(best).join(salary_view(snapshots, role), F.lit(True), "left")  # a row each


def jobs_page(spark, sf):
    return m.page(jobs(spark, sf), job_skills(spark, sf), 2, 20, role="ml_engineer", work_model="onsite", visa=True).select("job_id", "scraped_at", "company", "skills", "total", "pages")


def clustered_page(spark, sf):
    """The third page of filtered postings out of the clustered layout, with its skills."""
    rows = jobs(spark, sf).select("job_id", "scraped_at", "company", "role_category", "work_model", "offers_sponsorship")
    store = Clustered.temporary(rows, [("scraped_at", True), ("job_id", False)], ["role_category", "work_model", "offers_sponsorship"], 32)
    page = store.page(3, 20, role_category="ml_engineer", work_model="onsite", offers_sponsorship=True)
    own = job_skills(spark, sf).join(F.broadcast(page.select("job_id")), "job_id", "left_semi")  # at most 100 rows
    return page.join(m.top_skills_of(own), "job_id", "left").select("job_id", "scraped_at", "company", "skills", "total", "pages")


def top_skills_per_job(spark, sf):
    return m.top_skills_of(job_skills(spark, sf))


def unenriched_jobs(spark, sf):
    return m.unenriched(jobs(spark, sf), job_skills(spark, sf)).select("job_id", "role_category")


def implied_skills(spark, sf):
    bare = m.unenriched(jobs(spark, sf), job_skills(spark, sf))
    return m.implied(bare, job_skills(spark, sf), IMPLIED)


def pipeline_health(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_orderdate").alias("completed_at"))
    return health(log, F.lit("2001-08-03 06:00:00"))


def newest_of_role(spark, sf):
    return newest_sample(jobs(spark, sf), "data_scientist").select("job_id", "scraped_at")


_HAVE = ("Brand#3", "BRAND#14", "brand#25", "brand#7")


def skill_gaps(spark, sf):
    have = spark.createDataFrame([(s,) for s in _HAVE], "skill string")
    ranked = m.top(m.demand(jobs(spark, sf), job_skills(spark, sf), F.col("scraped_at") >= m.ts("2001-01-01")), "mentions", "skill", 20)
    return m.gaps(ranked, have, 8, 250)


def match_score(spark, sf):
    have = spark.createDataFrame([(s,) for s in _HAVE], "skill string")
    return m.match_score(m.demand(jobs(spark, sf), job_skills(spark, sf), F.lit(True)), have)


_SECTORS = {"East": (("brand#1", "brand#2", "brand#3"), 0.3), "West": (("brand#4", "brand#5", "brand#6", "brand#7"), 0.2)}


def _people(spark, sf):
    return job_skills(spark, sf).groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_set("skill")).alias("skills"))


def sector_fit(spark, sf):
    return m.sector_fit_exact(_people(spark, sf), _SECTORS)


def sector_fit_contained(spark, sf):
    return m.sector_fit_contained(_people(spark, sf), {k: v[0] for k, v in _SECTORS.items()}, 1)


def market_match(spark, sf):
    near = similarity.nearest_labels(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return similarity.match_histogram(near, "similarity")


def latest_snapshot(spark, sf):
    """K4 and the snapshot view: the last week's row wins for each role."""
    weekly = jobs(spark, sf).groupBy(F.date_trunc("week", "scraped_at").cast("date").alias("week_start"), F.coalesce("role_category", F.lit("other")).alias("role_category")).agg(F.count("*").alias("job_count"))
    order = Window.partitionBy("role_category").orderBy(F.desc("week_start"))
    return weekly.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


QUERIES = {
    f.__name__: f
    for f in (jobs_page, clustered_page, top_skills_per_job, unenriched_jobs, implied_skills, pipeline_health, newest_of_role, skill_gaps, match_score, sector_fit, sector_fit_contained, market_match, latest_snapshot)
}


def _with(sql: str) -> str:
    return f"WITH {CTE} {sql}"


_IMPLIED_ROWS = ", ".join(f"('{r}', '{s}', '{c}')" for r, found in IMPLIED.items() for s, c in found)
_HAVE_SQL = ", ".join(f"'{s.lower()}'" for s in _HAVE)
_EXACT = " UNION ALL ".join(
    f"SELECT id, '{n}' AS sector, round(len(list_intersect(skills, [{', '.join(repr(w) for w in ws)}]))::DOUBLE / {len(ws)} * 100, 1) AS fit_score, {rate}::DOUBLE AS sponsorship_rate FROM p" for n, (ws, rate) in _SECTORS.items()
)
_CONTAINED = " UNION ALL ".join(
    f"SELECT id, {k} AS n, '{n}' AS sector, round(({' + '.join(f'(len(list_filter(skills, lambda s: contains(s, {w!r}))) > 0)::INT' for w in ws)})::DOUBLE / {len(ws)}, 2) AS fit_score FROM p" for k, (n, (ws, _)) in enumerate(_SECTORS.items())
)
_PEOPLE = "p AS (SELECT job_id AS id, list_sort(list_distinct(list(skill))) AS skills FROM job_skills GROUP BY 1)"
ORACLES = {
    "jobs_page": _with(""", f AS (SELECT * FROM jobs WHERE role_category = 'ml_engineer' AND work_model = 'onsite' AND offers_sponsorship),
        t AS (SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::INT AS pages FROM f), g AS (SELECT * FROM f ORDER BY scraped_at DESC, job_id LIMIT 20 OFFSET 20),
        s AS (SELECT job_id, string_agg(skill, ', ' ORDER BY r) AS skills FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY confidence DESC, skill) AS r FROM job_skills) WHERE r <= 8 GROUP BY 1)
        SELECT job_id, scraped_at, company, skills, total, pages FROM g LEFT JOIN s USING (job_id), t"""),
    "top_skills_per_job": _with("SELECT job_id, string_agg(skill, ', ' ORDER BY r) AS skills FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY confidence DESC, skill) AS r FROM job_skills) WHERE r <= 8 GROUP BY 1"),
    "unenriched_jobs": _with("SELECT job_id, role_category FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM job_skills s WHERE s.job_id = j.job_id)"),
    "implied_skills": _with(f""", k(role, skill, skill_category) AS (VALUES {_IMPLIED_ROWS}), j AS (SELECT job_id, CASE WHEN role_category IN (SELECT role FROM k) THEN role_category ELSE 'other' END AS role
        FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM job_skills s WHERE s.job_id = j.job_id)) SELECT job_id, skill, skill_category, 'role_inference' AS extraction_method, 0.6::DOUBLE AS confidence FROM j JOIN k USING (role)"""),
    "pipeline_health": """SELECT max(o_orderdate) AS last_run, count(*) AS "rows", round(date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-03 06:00:00') / 3600.0::DOUBLE, 1) AS hours,
        CASE WHEN date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-03 06:00:00') / 3600.0 < 72 THEN 'healthy' ELSE 'stale' END AS status FROM orders""",
    "newest_of_role": _with(""", a AS (SELECT job_id, scraped_at FROM jobs WHERE role_category = 'data_scientist' ORDER BY scraped_at DESC, job_id LIMIT 300),
        b AS (SELECT job_id, scraped_at FROM jobs ORDER BY scraped_at DESC, job_id LIMIT 200)
        SELECT * FROM a WHERE (SELECT count(*) FROM a) >= 20 UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM a) < 20"""),
    "skill_gaps": _with(f""", r AS (SELECT skill, count(*) AS mentions FROM job_skills JOIN jobs USING (job_id) WHERE scraped_at >= TIMESTAMP '2001-01-01' GROUP BY 1 ORDER BY mentions DESC, skill LIMIT 20),
        g AS (SELECT * FROM r WHERE skill NOT IN ({_HAVE_SQL}) ORDER BY mentions DESC, skill LIMIT 8)
        SELECT *, row_number() OVER (ORDER BY mentions DESC, skill)::INT AS priority, CASE WHEN mentions > 250 THEN 'high' ELSE 'medium' END AS importance FROM g"""),
    "match_score": _with(f", r AS (SELECT skill FROM job_skills JOIN jobs USING (job_id) GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 10) SELECT round(count(*) FILTER (skill IN ({_HAVE_SQL}))::DOUBLE / greatest(count(*), 1), 2) AS match_score FROM r"),
    "sector_fit": _with(f", {_PEOPLE}, s AS ({_EXACT}) SELECT * FROM s WHERE fit_score > 0"),
    "sector_fit_contained": _with(f", {_PEOPLE}, s AS ({_CONTAINED}) SELECT id, sector, fit_score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fit_score DESC, n) AS r FROM s) WHERE r = 1"),
    "market_match": """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
        s AS (SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS similarity FROM e JOIN c USING (label, i) GROUP BY 1)
        SELECT round(avg((similarity > 0.75)::INT::DOUBLE), 4) AS strong, round(avg((similarity > 0.55 AND similarity <= 0.75)::INT::DOUBLE), 4) AS moderate, round(avg((similarity <= 0.55)::INT::DOUBLE), 4) AS weak,
        round(least(greatest(avg(similarity) * 100, 0), 100), 2) AS match_pct FROM s""",
    "latest_snapshot": _with(""", w AS (SELECT date_trunc('week', scraped_at)::DATE AS week_start, coalesce(role_category, 'other') AS role_category, count(*) AS job_count FROM jobs GROUP BY 1, 2)
        SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY role_category ORDER BY week_start DESC) = 1"""),
}
ORACLES["clustered_page"] = ORACLES["jobs_page"].replace("LIMIT 20 OFFSET 20", "LIMIT 20 OFFSET 40")
