"""CV analysis end to end, career pages, integrity of postings, and the remaining store and read views, with oracles.

CVs are PDF files put together from customers' keys, as the tables hold none; they are scanned, parsed and read like any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skills
from tidemark.functions import text as t
from tidemark.operators import cubes, quality, skillvec, stores
from tidemark.operators import market as m
from tidemark.operators.keyed import replaced, temporary
from tidemark.plans import serving
from tidemark.plans.market import _MID, _PAY, AFTER, BEFORE, PLACES, _cells, _snapshot
from tidemark.plans.records import _PII_SQL
from tidemark.sources import landed
from tidemark.sources.binding import CTE, WEEK, job_skills, jobs
from tidemark.sources.schemas import conform
from tidemark.sources.tables import table
from tidemark.tables import drop_table, write_table

#: The names that the tables' postings ask for.
BRANDS = tuple((f"Brand#{n}", "brand", ()) for n in range(1, 26))
#: Skills of a role that a CV is held against, those that make up its score, and gaps told.
ASKED, TOP, GAPS = 20, 10, 8
#: Tasks a core that CV files are dealt to: reading one is much work for few bytes, by which Spark would deal them.
DEALT = 3


def demanded(jobs_: DataFrame, skills_: DataFrame, role: str, since: str, until: str, k: int = ASKED) -> DataFrame:
    """The role's k most named skills of a time: skill (lower case), rank, demand, salary and recency from 0 to 1.

    demand: mentions by those of the first; salary: mean midpoint of the postings that name it by the highest mean;
    recency: its share of mentions in the last quarter of the time, by the largest such share.
    """
    inside = (F.col("scraped_at") >= m.ts(since)) & (F.col("scraped_at") < m.ts(until)) & (F.col("role_category") == role)
    start, end = (F.unix_date(F.lit(x).cast("date")) for x in (since, until))
    late = F.unix_date(F.to_date("scraped_at")) >= end - F.floor((end - start) / 4)
    paid = F.when(m.usable_pay(), m.midpoint(F.col("salary_min"), F.col("salary_max")))
    asked = skills_.join(jobs_.filter(inside).select("job_id", late.alias("late"), paid.alias("paid")), "job_id")
    named = asked.groupBy(F.lower("skill").alias("skill")).agg(F.count("*").alias("mentions"), F.avg("paid").alias("pay"), F.avg(F.col("late").cast("double")).alias("new"))
    first = named.orderBy(F.desc("mentions"), "skill").limit(k)
    best = first.agg(*[F.max(c).alias(f"_{c}") for c in ("mentions", "pay", "new")])
    share = lambda c: F.round(F.coalesce(F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0)), F.lit(0.0)), 6)
    rows = first.crossJoin(F.broadcast(best)).select("skill", "mentions", share("mentions").alias("demand"), share("pay").alias("salary"), share("new").alias("recency"))  # one row is broadcast
    ranked = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("o"), "skill", "demand", "salary", "recency"))).alias("l"))  # k rows
    return ranked.select(F.posexplode("l").alias("at", "s")).select((F.col("at") + 1).alias("rank"), "s.skill", "s.demand", "s.salary", "s.recency")


def analyse(files: DataFrame, demand: DataFrame, taxonomy=skills.SKILLS) -> DataFrame:
    """Every file (id, content) in one row: whether it may be opened and why not, what personal data it holds, five scores with
    total and grade, its skills, the match with the role's first TOP skills, and its first GAPS missing ones with when to learn each.

    Only the scrubbed text is read for skills and words. A file that may not be opened, or cannot be parsed, has
    a reason and nothing else. ids are unique. demand: of `demanded`.
    """
    tasks = DEALT * files.sparkSession.sparkContext.defaultParallelism
    scanned = files.repartition(tasks, "id").select("id", "content", landed.scan_file("content").alias("scan")).select("id", "content", "scan.*")
    parsed = scanned.withColumn("cv", F.when(F.col("allowed"), landed.parse_cv("content", "file_type")))
    reason = F.coalesce("rejection_reason", "cv.error")
    told = parsed.select("id", (F.col("allowed") & F.col("cv.error").isNull()).alias("allowed"), reason.alias("rejection_reason"), F.when(reason.isNull(), F.col("cv.raw_text")).alias("text"))
    told = write_table(told.withColumn("raw_text", F.coalesce(t.scrub(F.col("text")), F.lit(""))), "texts")  # what follows reads it more than once
    read = told.withColumns({"pii": t.pii_types(F.col("text")), "sections": t.sections(F.col("raw_text")), "page_count": F.lit(1), "has_tables": F.lit(False), "has_images": F.lit(False)})
    kept = write_table(read.select("*", t.contact_flags(F.coalesce("text", F.lit(""))).alias("f")).select("*", "f.*").drop("f", "text"), "read")
    drop_table(told)
    wanted = demand.agg(F.array_sort(F.collect_list(F.struct("rank", "skill", "demand", "salary", "recency"))).alias("wanted"))  # ASKED rows
    read = kept.crossJoin(F.broadcast(wanted)).withColumn("first", F.transform(F.slice("wanted", 1, TOP), lambda x: x["skill"]))  # one row is broadcast
    scored = t.ats_scores(read, F.col("first"))
    own = skills.extract(read.filter("allowed"), "id", "raw_text", taxonomy).groupBy("id").agg(F.array_sort(F.collect_set(F.lower("skill"))).alias("skills"))
    met = scored.join(own, "id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    missing = F.slice(F.filter("wanted", lambda x: ~F.array_contains(F.col("skills"), x["skill"])), 1, GAPS)
    met = met.withColumns({"match_score": F.round(F.size(F.array_intersect("skills", "first")) / F.greatest(F.size("first"), F.lit(1)), 2), "missing": missing})
    met = write_table(met.drop("raw_text", "sections", "wanted", "first"), "met")
    drop_table(kept)
    plan = t.gap_plan(met.filter("allowed").select(F.col("id").alias("person"), F.explode("missing").alias("x")).select("person", "x.rank", "x.skill", "x.demand", "x.salary", "x.recency"))
    plan = plan.groupBy(F.col("person").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "skill", "priority_score", "horizon"))).alias("gaps"))
    only = lambda c: F.when(F.col("allowed"), F.col(c)).alias(c)
    return met.join(plan, "id", "left").select("id", "allowed", "rejection_reason", *[only(c) for c in ("pii", "keyword", "structure", "readability", "completeness", "format", "total", "grade", "issues", "skills", "match_score", "gaps")])


def _raw(k):
    own = [F.concat(F.lit("Brand#"), (F.pmod(k * step + add, F.lit(25)) + 1).cast("string")) for step, add in ((1, 0), (3, 5), (7, 11))]
    return F.concat_ws(
        "\n", "c_name", F.when(k % 4 != 0, F.concat(F.lit("mail c"), k.cast("string"), F.lit("@example.org"))), F.when(k % 6 == 1, "born DOB: 01/02/1990"),
        F.lit("Experience"), F.concat(F.lit("Led work with "), own[0], F.lit(" since 2015. Improved output by 40%.")), F.lit("Skills"), F.concat_ws(", ", *own), F.when(k % 3 == 0, F.lit("Education\nBSc Maths")),
    )


def _cv_files(spark, sf):
    """A PDF a customer; every 17th with a script in it, every 19th of no known kind, every 23rd empty."""
    k = F.col("c_custkey")
    shown = F.array_join(F.transform(F.split(_raw(k), "\n"), lambda x: F.concat(F.lit("("), x, F.lit(") Tj"))), "\n")
    pdf = F.concat(F.lit("%PDF-1.4\n"), F.when(k % 17 == 0, "/JavaScript\n").otherwise(""), F.lit("stream\nBT\n"), shown, F.lit("\nET\nendstream"))
    body = F.when(k % 23 == 0, "").when(k % 19 == 0, "plain words").otherwise(pdf)
    return table(spark, sf, "customer").select(k.alias("id"), body.cast("binary").alias("content"))


def cv_analysis(spark, sf):
    """The composed analysis of every CV against the data scientists' postings of half a year."""
    demand = demanded(jobs(spark, sf), job_skills(spark, sf), "data_scientist", "1998-01-01", "1998-07-01")
    out = analyse(_cv_files(spark, sf), demand, BRANDS)
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat_ws(":", g["skill"], g["horizon"])), ",")
    return out.select("id", "allowed", "rejection_reason", F.array_join("pii", ",").alias("pii"), F.round("keyword", 4).alias("keyword"), "structure", "completeness", F.array_join("skills", ",").alias("skills"), "match_score", gaps.alias("gaps"))


#: Columns of the skill vectors here; the tables name 25 skills.
RANK = 12


def market_match_by_vectors(spark, sf):
    """Every customer's skills, as the CVs name them, against the 300 newest data scientists' postings by skill vectors of a year's postings."""
    j, s = jobs(spark, sf), job_skills(spark, sf)
    year = j.filter((F.col("scraped_at") >= m.ts("1998-01-01")) & (F.col("scraped_at") < m.ts("1999-01-01")))
    known = skillvec.vectors(skillvec.ppmi(s.join(year.select("job_id"), "job_id", "left_semi")), RANK)
    k = F.col("c_custkey")
    named = F.array(*[F.concat(F.lit("brand#"), (F.pmod(k * step + add, F.lit(25)) + 1).cast("string")) for step, add in ((1, 0), (3, 5), (7, 11))])
    people = table(spark, sf, "customer").select(k.alias("id"), F.explode(named).alias("skill"))
    return skillvec.market_match(people, serving.newest_sample(j, "data_scientist"), s, known, RANK)


def career_postings(spark, sf):
    """Every page's ld+json postings, or its links; every third page is given a script and every second two links."""
    k = F.col("page_id")
    script = F.concat(F.lit('<script type="application/ld+json">[{"@type":"JobPosting","title":"NLP developer '), k.cast("string"), F.lit('","description":"<p>d</p>","url":"https://j.io/'), k.cast("string"), F.lit('"},{"@type":"Person","title":"NLP"}]</script>'))
    anchors = F.concat(F.lit('<a href="/open/'), k.cast("string"), F.lit('">Machine Learning lead</a><a class="x" href="https://o.io/a">Research <b>Scientist</b></a>'))
    html = F.concat(F.when(k % 3 == 0, script).otherwise(""), F.when(k % 2 == 0, anchors).otherwise(""), F.coalesce("html", F.lit("")))
    return landed.career_pages(table(spark, sf, "pages").withColumn("html", html), "page_id", "html", "url")


def posting_integrity(spark, sf):
    """The eight checks over the postings of a time, among them pay whose ends are crossed, dates ahead of the run, and skills without a posting."""
    j = jobs(spark, sf).withColumn("salary_max", F.when(F.col("job_id") % 50 == 1, F.col("salary_min") - 1).otherwise(F.col("salary_max")))
    held = j.filter(F.col("scraped_at") >= m.ts("1996-01-01"))
    return quality.posting_integrity(held, job_skills(spark, sf), m.ts("2001-06-01"))


def market_skills(spark, sf):
    """/market/skills: a role's latest snapshot, and that of all roles for one that has none."""
    stored = conform(cubes.snapshot(_cells(spark, sf, BEFORE, AFTER), WEEK, 50, PLACES), "weekly_snapshots")
    one = lambda role: serving.skills_view(stored, role).select(F.lit(role).alias("asked"), "role_category", "week_start", "job_count", F.array_join(F.transform(F.slice("top_skills", 1, 10), lambda x: x["skill"]), ",").alias("top"))
    return one("data_scientist").unionByName(one("nobody"))


def skill_store(spark, sf):
    """K3: skills of postings in a store by posting and skill: the first two lines of an order, then all lines; what is there stays."""
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("job_id"), F.lower("p_brand").alias("skill"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), "l_linenumber")
    first = rows.filter("l_linenumber <= 2").groupBy("job_id", "skill").agg(F.max("confidence").alias("confidence"))
    store = temporary(first, ["job_id", "skill"])
    store.merge(rows.select("job_id", "skill", "confidence"), lambda old, new: stores.append_unknown(old, new, ["job_id", "skill"]))
    return store.read()


def snapshot_store(spark, sf):
    """K4, K6: the snapshots of two weeks in a store by week and role, the later week written twice; last write wins, other rows stay."""
    cells = _cells(spark, sf, "1998-05-18", AFTER)
    snap = lambda week: conform(cubes.snapshot(cells, week, 50, PLACES), "weekly_snapshots").select("week_start", "role_category", "job_count", "salary_p50", "salary_sample_size")
    keys = ["week_start", "role_category"]
    store = temporary(snap(BEFORE), keys, 4)
    later = snap(WEEK)
    for run, rows in enumerate((later.withColumn("job_count", F.col("job_count") + 1), later, later)):
        store.merge(rows, lambda old, new: replaced(old, new, keys), "weekly", min(run, 1))  # the last comes again, and is passed over
    return store.read()


QUERIES = {f.__name__: f for f in (cv_analysis, market_match_by_vectors, career_postings, posting_integrity, market_skills, skill_store, snapshot_store)}

_K = "c_custkey"
_OWN = [f"'Brand#' || (({_K} * {step} + {add}) % 25 + 1)" for step, add in ((1, 0), (3, 5), (7, 11))]
_TEXT = f"""concat_ws(chr(10), c_name, CASE WHEN {_K} % 4 <> 0 THEN 'mail c' || {_K} || '@example.org' END, CASE WHEN {_K} % 6 = 1 THEN 'born DOB: 01/02/1990' END, 'Experience', 'Led work with ' || {_OWN[0]} || ' since 2015. Improved output by 40%.',
    'Skills', {" || ', ' || ".join(_OWN)}, CASE WHEN {_K} % 3 = 0 THEN 'Education' || chr(10) || 'BSc Maths' END)"""
_HREF = """(?is)<a\\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""
_AI = "machine learning|ml engineer|ai engineer|data scientist|llm|nlp|computer vision|deep learning|pytorch|mlops|research scientist|applied scientist|generative ai"
_SNAP_COLUMNS = "week_start, role_category, job_count, salary_p50, salary_sample_size"
ORACLES = {
    "cv_analysis": f"""WITH {CTE}, d AS (SELECT skill, count(*) AS n, avg(CASE WHEN {_PAY} THEN {_MID} END) AS pay, avg((scraped_at::DATE >= DATE '1998-07-01' - ((DATE '1998-07-01' - DATE '1998-01-01') // 4)::INT)::INT::DOUBLE) AS fresh
            FROM job_skills JOIN jobs USING (job_id) WHERE role_category = 'data_scientist' AND scraped_at >= TIMESTAMP '1998-01-01' AND scraped_at < TIMESTAMP '1998-07-01' GROUP BY 1 ORDER BY n DESC, skill LIMIT {ASKED}),
        w AS (SELECT skill, row_number() OVER (ORDER BY n DESC, skill) AS rank, round(coalesce(n::DOUBLE / nullif(max(n) OVER (), 0), 0), 6) AS demand, round(coalesce(pay / nullif(max(pay) OVER (), 0), 0), 6) AS salary, round(coalesce(fresh / nullif(max(fresh) OVER (), 0), 0), 6) AS recency FROM d),
        c AS (SELECT {_K} AS id, {_K} % 17 = 0 AS script, {_K} % 19 = 0 AS odd, {_K} % 23 = 0 AS bare, {_TEXT} AS text FROM customer),
        o AS (SELECT *, NOT (script OR odd OR bare) AS allowed, CASE WHEN bare THEN 'empty_file' WHEN odd THEN 'unsupported_file_type' WHEN script THEN 'pdf_dangerous_content' END AS rejection_reason FROM c),
        s AS (SELECT DISTINCT id, unnest(list_transform(regexp_extract_all(lower(text), 'brand#[0-9]+'), lambda x: x)) AS skill FROM o WHERE allowed),
        l AS (SELECT id, list_sort(list(skill)) AS skills FROM s GROUP BY 1), f AS (SELECT list(skill ORDER BY rank) FILTER (rank <= {TOP}) AS first, count(*) FILTER (rank <= {TOP}) AS tops FROM w),
        g AS (SELECT id, w.skill, rank, row_number() OVER (PARTITION BY id ORDER BY rank) AS r, round(demand * salary * recency, 6) AS p FROM l, w WHERE NOT list_contains(l.skills, w.skill)),
        h AS (SELECT *, ['short', 'mid', 'long'][ntile(3) OVER (PARTITION BY id ORDER BY p DESC, skill)] AS horizon FROM g WHERE r <= {GAPS}),
        q AS (SELECT id, string_agg(skill || ':' || horizon, ',' ORDER BY rank) AS gaps FROM h GROUP BY 1)
        SELECT o.id, allowed, rejection_reason, CASE WHEN allowed THEN {_PII_SQL} END AS pii, CASE WHEN allowed THEN round(len(list_filter(first, lambda x: contains(lower(text), x)))::DOUBLE / len(first) * 100, 4) END AS keyword,
        CASE WHEN allowed THEN 95.0 - CASE WHEN o.id % 3 = 0 THEN 0 ELSE 25 END END::DOUBLE AS structure,
        CASE WHEN allowed THEN 100.0 - CASE WHEN o.id % 4 = 0 THEN 20 ELSE 0 END - 10 - CASE WHEN o.id % 3 = 0 THEN 0 ELSE 15 END END::DOUBLE AS completeness,
        CASE WHEN allowed THEN array_to_string(skills, ',') END AS skills, CASE WHEN allowed THEN round(len(list_intersect(skills, first))::DOUBLE / greatest(tops, 1), 2) END AS match_score, gaps
        FROM o LEFT JOIN l USING (id) LEFT JOIN q USING (id), f""",
    "career_postings": f"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '<a href="/open/' || page_id || '">Machine Learning lead</a><a class="x" href="https://o.io/a">Research <b>Scientist</b></a>' ELSE '' END || coalesce(html, '') AS html FROM pages WHERE page_id % 3 <> 0),
        a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF}')) AS a, generate_subscripts(regexp_extract_all(html, '{_HREF}'), 1) AS pos FROM p),
        b AS (SELECT page_id, pos, regexp_extract(a, '(?is)href=["'']([^"'']+)["'']', 1) AS h, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM a),
        d AS (SELECT page_id, CASE WHEN starts_with(h, '/') THEN root || h ELSE h END AS href, arg_min(text, pos) AS text, min(pos) AS pos FROM b WHERE length(text) BETWEEN 5 AND 100 AND regexp_matches(lower(text), '{_AI}') GROUP BY 1, 2)
        SELECT page_id, text AS title, href AS url, 'links' AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM d) WHERE r <= {landed.LINKS}
        UNION ALL SELECT page_id, 'NLP developer ' || page_id, 'https://j.io/' || page_id, 'jsonld' FROM pages WHERE page_id % 3 = 0""",
    "posting_integrity": f"""WITH {CTE}, h AS (SELECT * REPLACE (CASE WHEN job_id % 50 = 1 THEN salary_min - 1 ELSE salary_max END AS salary_max) FROM jobs WHERE scraped_at >= TIMESTAMP '1996-01-01')
        SELECT count(*) AS total_rows, round(avg((company IS NULL)::INT), 6) AS null_company, round(avg((role_category IS NULL)::INT), 6) AS null_role, round(avg((salary_min IS NULL AND salary_max IS NULL)::INT), 6) AS null_salary,
        count(*) FILTER (salary_min NOT BETWEEN 10000 AND 600000 OR salary_max NOT BETWEEN 10000 AND 600000) AS salary_out_of_range, count(*) FILTER (salary_min > salary_max) AS salary_crossed, count(*) FILTER (scraped_at > TIMESTAMP '2001-06-01') AS future_dates,
        (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM h GROUP BY company, coalesce(role_category, ''), location, scraped_at::DATE)) AS copies, (SELECT count(*) FROM job_skills WHERE job_id NOT IN (SELECT job_id FROM h)) AS orphan_skills FROM h""",
    "market_skills": f"""WITH {CTE}, {_snapshot(WEEK)}, a AS (SELECT *, array_to_string(list_transform(string_split(top_skills, ',')[1:10], lambda x: string_split(x, '=')[1]), ',') AS top FROM snap)
        SELECT 'data_scientist' AS asked, role_category, week_start, job_count, top FROM a WHERE role_category = 'data_scientist' UNION ALL SELECT 'nobody', role_category, week_start, job_count, top FROM a WHERE role_category = 'all'""",
    "skill_store": """WITH r AS (SELECT l_orderkey AS job_id, lower(p_brand) AS skill, round(1 - l_discount, 4) AS confidence, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT job_id, skill, coalesce(max(confidence) FILTER (l_linenumber <= 2), min(confidence)) AS confidence FROM r GROUP BY 1, 2""",
    "snapshot_store": f"WITH {CTE}, {_snapshot(WEEK)}, {_snapshot(BEFORE, '_b')} SELECT {_SNAP_COLUMNS} FROM snap UNION ALL SELECT {_SNAP_COLUMNS} FROM snap_b",
}
