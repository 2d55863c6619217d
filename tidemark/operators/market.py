"""Market operators over postings (jobs) and their skills (job_skills), all declarative.

Where several windows are compared, they are taken in one scan by conditional sums. Lists that are cut
to a length end in a unique tie-breaker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import midpoint, nearest_rank
from tidemark.functions.vocabulary import CITIES

PERCENTS = (10, 25, 50, 75, 90)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def shifted(week: str, days: int) -> Column:
    return ts(week) + F.expr(f"interval {days} days") if days >= 0 else ts(week) - F.expr(f"interval {-days} days")


def in_week(week: str, back: int = 0, column: str = "scraped_at") -> Column:
    """Half-open: the week that starts `back` weeks before `week`."""
    return (F.col(column) >= shifted(week, -7 * back)) & (F.col(column) < shifted(week, 7 - 7 * back))


def demand(jobs: DataFrame, skills: DataFrame, when: Column, keys: tuple[str, ...] = ("skill",)) -> DataFrame:
    """Mentions by key in the window; copies within a posting count."""
    return skills.join(jobs.filter(when), "job_id").groupBy(*keys).agg(F.count("*").alias("mentions"))


def top(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def top_per(df: DataFrame, group: str, by: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(by), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def demand_weeks(jobs: DataFrame, skills: DataFrame, week: str, weeks: int = 2) -> DataFrame:
    """Mentions by skill in `week` and the weeks before (w0, w1, ...), in one scan."""
    window = (F.col("scraped_at") >= shifted(week, 7 - 7 * weeks)) & (F.col("scraped_at") < shifted(week, 7))
    sums = [F.count_if(in_week(week, b)).alias(f"w{b}") for b in range(weeks)]
    return skills.join(jobs.filter(window), "job_id").groupBy("skill").agg(*sums)


def movers(jobs: DataFrame, skills: DataFrame, week: str, k: int = 20) -> DataFrame:
    """Rising and declining skills among this week's 50 most named; each list cut at k in order of mentions."""
    current = demand_weeks(jobs, skills, week).filter("w0 > 0").orderBy(F.desc("w0"), "skill").limit(50)
    change = F.when(F.col("w1") > 0, (F.col("w0") - F.col("w1")) / F.col("w1"))
    kind = F.when(change > 0.5, "rising").when(change < -0.3, "declining").when((F.col("w1") == 0) & (F.col("w0") > 5), "rising")
    told = current.withColumn("direction", kind).filter("direction is not null")
    return top_per(told, "direction", "w0", "skill", k)


def anomalies(jobs: DataFrame, skills: DataFrame, week: str, times: int = 5) -> DataFrame:
    """Skills named over `times` as often as the week before."""
    return demand_weeks(jobs, skills, week).filter((F.col("w1") > 0) & (F.col("w0") > times * F.col("w1")))


def churn(jobs: DataFrame, skills: DataFrame, week: str, k: int = 10) -> DataFrame:
    """How many of this week's top k were not in last week's; up to 3 is good."""
    weeks = demand_weeks(jobs, skills, week)
    lists = [weeks.filter(f"{w} > 0").orderBy(F.desc(w), "skill").limit(k).agg(F.collect_list("skill").alias(w)) for w in ("w0", "w1")]
    both = lists[0].crossJoin(lists[1])  # a row each
    return both.select(F.size(F.array_except("w0", "w1")).alias("new_in_top"), (F.size(F.array_except("w0", "w1")) <= 3).alias("stable"))


def with_fallback(first: DataFrame, second: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first frame's top rows, or the second's where the first has none; one plan, no action."""
    both = first.withColumn("_try", F.lit(0)).unionByName(second.withColumn("_try", F.lit(1)))
    best = both.agg(F.min("_try").alias("_best"))
    return both.join(F.broadcast(best), F.col("_try") == F.col("_best")).drop("_try", "_best").orderBy(*order).limit(k)  # one row is broadcast


def usable_pay() -> Column:
    return (F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()) & (F.col("salary_min") > 10000) & (F.col("salary_max").isNull() | (F.col("salary_max") < 600000))


def salaries(jobs: DataFrame) -> DataFrame:
    """Postings whose pay can be used, with its midpoint (mid)."""
    return jobs.filter(usable_pay()).withColumn("mid", midpoint(F.col("salary_min"), F.col("salary_max")))


def percentiles(df: DataFrame, value: str, keys: tuple[str, ...] = (), percents=PERCENTS, least: int = 5, width: float = 256.0, weight: str | None = None) -> DataFrame:
    """Floor nearest-rank percentiles by group, rounded to integers, null below `least` values, and the sample size.
    weight: a column that says how often the row's value occurs.

    No group is gathered or sorted whole: values are counted, counts are summed into bins of `width`, and a
    running sum over a group's bins tells which bins hold the ranks; only these few are looked into.
    """
    keys = tuple(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n")).withColumn("_bin", F.floor(F.col(value) / width))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in"))
    bins = bins.withColumn("_to", F.sum("_in").over(part.orderBy("_bin"))).withColumn("_all", F.sum("_in").over(part)).withColumn("_before", F.col("_to") - F.col("_in"))
    ranks = [nearest_rank(F.col("_all"), p) for p in percents]
    bins = bins.filter(reduce(lambda a, b: a | b, [(F.col("_before") < r) & (r <= F.col("_to")) for r in ranks]))
    renamed = bins.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_bin").alias("_b"), "_before", "_all")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)], F.col("_bin") == F.col("_b"))
    inside = counted.join(renamed, same)
    run = Window.partitionBy(*keys, "_bin").orderBy(value)
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(run))
    hit = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    picks = [F.round(F.max(F.when((F.col("_all") >= least) & hit(r), F.col(value))), 0).alias(f"p{p}") for p, r in zip(percents, ranks)]
    return ranked.groupBy(*keys).agg(F.coalesce(F.max("_all"), F.lit(0)).alias("sample_size"), *picks)


def salary_ladder(jobs: DataFrame, week: str, days: tuple[int, ...] = (7, 30, 90), least: int = 5) -> DataFrame:
    """Percentiles over the first window (a week, else 30 days, else 90) with `least` usable rows, with disclosure.

    One scan: every row knows the shortest window that holds it, so a window's rows are those of its steps.
    """
    end = shifted(week, 7)
    since = [shifted(week, 0), *[end - F.expr(f"interval {d} days") for d in days[1:]]]
    near = jobs.filter((F.col("scraped_at") < end) & (F.col("scraped_at") >= since[-1]))
    step = reduce(lambda out, k: F.when(F.col("scraped_at") >= since[k], k).otherwise(out), reversed(range(len(days))), F.lit(len(days)))
    near = near.withColumn("_step", step)
    usable = salaries(near)
    sums = [F.count_if(F.col("_step") <= k).alias(f"n{k}") for k in range(len(days))]
    chosen = usable.agg(*sums).select(reduce(lambda out, k: F.when(F.col(f"n{k}") >= least, k).otherwise(out), reversed(range(len(days))), F.lit(len(days) - 1)).alias("_chosen"))
    usable = usable.join(F.broadcast(chosen), F.col("_step") <= F.col("_chosen"))  # one row is broadcast
    inside = usable.filter(F.col("mid").between(20000, 300000))
    total = near.join(F.broadcast(chosen), F.col("_step") <= F.col("_chosen")).agg(F.count("*").alias("total"), F.max("_chosen").alias("_chosen"))
    window = F.element_at(F.array(*map(F.lit, days)), F.col("_chosen") + 1)
    return percentiles(inside, "mid", least=least).crossJoin(total).select(
        *[f"p{p}" for p in PERCENTS], "sample_size", F.round(F.col("sample_size") / F.greatest("total", F.lit(1)), 3).alias("disclosure_rate"), window.alias("window_days")
    )


def sponsorship_by(jobs: DataFrame, keys: tuple[str, ...] = ("role_category", "company_stage"), least: int = 10) -> DataFrame:
    """Share of postings that offer sponsorship among those that say, by group, from `least` postings on."""
    said = jobs.filter(F.col("offers_sponsorship").isNotNull())
    role = F.coalesce("role_category", F.lit("unknown")).alias("role_category")
    return (
        said.withColumn("role_category", role)
        .groupBy(*keys)
        .agg(F.count("*").alias("postings"), F.count_if("offers_sponsorship").alias("offering"))
        .filter(F.col("postings") >= least)
        .withColumn("rate", F.round(F.col("offering") / F.col("postings"), 3))
    )


def sponsorship_rate(jobs: DataFrame) -> DataFrame:
    """Overall rate; postings that do not say count in the denominator."""
    return jobs.agg(F.count("*").alias("postings"), F.round(F.count_if("offers_sponsorship") / F.count("*"), 3).alias("rate"))


def momentum(jobs: DataFrame, week: str, k: int = 20, weights=(1.0, 0.6, 0.3)) -> DataFrame:
    """Companies by weighted postings of three weeks, in one scan."""
    window = (F.col("scraped_at") >= shifted(week, -14)) & (F.col("scraped_at") < shifted(week, 7))
    weeks = [F.count_if(in_week(week, b)).alias(f"w{b}") for b in range(3)]
    score = F.round(sum(F.lit(w) * F.col(f"w{b}") for b, w in enumerate(weights)), 2)
    return jobs.filter(window).groupBy("company").agg(*weeks).withColumn("momentum", score).filter("momentum > 0").orderBy(F.desc("momentum"), "company").limit(k)


def expansions(jobs: DataFrame, week: str, quiet: DataFrame) -> DataFrame:
    """Companies that were quiet (a state table of names) and post this week."""
    return jobs.filter(in_week(week)).groupBy("company").agg(F.count("*").alias("w0")).join(quiet.select("company"), "company", "left_semi")


def quiet_companies(jobs: DataFrame, week: str) -> DataFrame:
    """The next state: companies of the three weeks before that post nothing this week."""
    window = (F.col("scraped_at") >= shifted(week, -21)) & (F.col("scraped_at") < shifted(week, 7))
    return jobs.filter(window).groupBy("company").agg(F.count_if(in_week(week)).alias("w0")).filter("w0 = 0").select("company")


def role_velocity(jobs: DataFrame, when: Column, otherwise: Column | None = None) -> DataFrame:
    """Postings by role in the window, or in the other window where that has none."""
    count = lambda c: jobs.filter(c).groupBy(F.coalesce("role_category", F.lit("other")).alias("role")).agg(F.count("*").alias("postings"))
    return count(when) if otherwise is None else with_fallback(count(when), count(otherwise), [F.desc("postings"), F.col("role")], 100)


def canonical_place(location: Column, patterns) -> Column:
    """Exact match first, then the first pattern contained, else Other; null or empty stays null."""
    low = F.trim(F.lower(location))
    exact = F.create_map(*[F.lit(x) for kv in dict(patterns).items() for x in kv])[low]
    inside = reduce(lambda out, kv: F.when(low.contains(kv[0]), kv[1]).otherwise(out), reversed(patterns), F.lit("Other"))
    return F.when(low != "", F.coalesce(exact, inside))


def places(jobs: DataFrame, when: Column, patterns, k: int = 20) -> DataFrame:
    """Postings by canonical place, counted by raw location first so that the patterns meet distinct strings only."""
    raw = jobs.filter(when).filter(F.coalesce("location", F.lit("")) != "").groupBy("location", "work_model").agg(F.count("*").alias("n"))
    return raw.groupBy(canonical_place(F.col("location"), patterns).alias("place")).agg(F.sum("n").alias("postings")).orderBy(F.desc("postings"), "place").limit(k)


def place_share(jobs: DataFrame, week: str, patterns, place: str) -> DataFrame:
    """One place's share this week and last, whether it moved over 0.10, and whether it is below 0.2."""
    named = jobs.filter(in_week(week) | in_week(week, 1)).withColumn("place", canonical_place(F.col("location"), patterns)).filter("place is not null")
    share = lambda b: F.count_if(in_week(week, b) & (F.col("place") == place)) / F.count_if(in_week(week, b))
    one = named.agg(F.round(share(0), 4).alias("share"), F.round(share(1), 4).alias("before"))
    return one.select("share", "before", (F.abs(F.col("share") - F.col("before")) > 0.10).alias("shifted"), (F.col("share") < 0.2).alias("low"))


def cooccurrence(jobs: DataFrame, skills: DataFrame, when: Column, k: int = 200, least: int = 3) -> DataFrame:
    """Pairs of skills by pointwise mutual information over postings; pairs seen in `least` postings, PMI above 0.

    A posting's distinct skills are few, so pairs are formed inside one array per posting, without a self-join.
    """
    sets = skills.join(jobs.filter(when), "job_id").groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("s"))
    single = sets.select(F.explode("s").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    inner = lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", inner))).alias("p")).groupBy(F.col("p.a").alias("skill_a"), F.col("p.b").alias("skill_b")).agg(F.count("*").alias("co_count")).filter(F.col("co_count") >= least)
    total = sets.agg(F.count("*").alias("total"))
    met = pairs.join(single.select(F.col("skill").alias("skill_a"), F.col("n").alias("na")), "skill_a").join(single.select(F.col("skill").alias("skill_b"), F.col("n").alias("nb")), "skill_b")
    pmi = F.round(F.log(F.col("co_count").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb"))), 4)
    return met.crossJoin(F.broadcast(total)).withColumn("pmi", pmi).filter("pmi > 0").select("skill_a", "skill_b", "pmi", "co_count").orderBy(F.desc("pmi"), F.desc("co_count"), "skill_a", "skill_b").limit(k)


def archetypes(jobs: DataFrame, skills: DataFrame, when: Column, stacks: dict) -> DataFrame:
    """Demand share of each stack among the 50 most named skills: per word the first skill (by mentions) that contains it or is contained in it."""
    fifty = top(demand(jobs, skills, when), "mentions", "skill", 50).withColumn("skill", F.lower("skill"))
    words = fifty.sparkSession.createDataFrame([(a, n, w) for a, ws in stacks.items() for n, w in enumerate(ws)], "archetype string, n int, word string")
    met = fifty.join(F.broadcast(words), F.expr("contains(skill, word) or contains(word, skill)"))  # at most 50 rows meet a fixed list
    first = top_per(met.withColumn("_g", F.concat_ws("\u0001", "archetype", "n")), "_g", "mentions", "skill", 1)
    total = fifty.agg(F.sum("mentions").alias("total"))
    sums = words.select("archetype").distinct().join(first.groupBy("archetype").agg(F.sum("mentions").alias("named"), F.count("*").alias("skill_count"), F.array_sort(F.collect_list(F.struct("n", "skill"))).alias("l")), "archetype", "left")
    share = F.round(F.coalesce("named", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(1)), F.lit(1)), 4)
    return sums.crossJoin(F.broadcast(total)).select(
        "archetype", share.alias("demand_share"), F.coalesce("skill_count", F.lit(0)).alias("skill_count"), F.array_join(F.slice(F.transform("l", lambda x: x["skill"]), 1, 5), ",").alias("dominant_skills")
    )


def job_count_ladder(jobs: DataFrame, week: str) -> DataFrame:
    """Postings of the week, else of 30 days, else of 90, else all."""
    end = shifted(week, 7)
    since = lambda d: (F.col("scraped_at") >= end - F.expr(f"interval {d} days")) & (F.col("scraped_at") < end)
    steps = [F.nullif(F.count_if(c), F.lit(0)) for c in (in_week(week), since(30), since(90))]
    return jobs.agg(F.coalesce(*steps, F.count("*")).alias("job_count"))


def migration_signals(now: DataFrame, before: DataFrame, fall: float = 0.75) -> DataFrame:
    """Archetypes (archetype, demand_share) whose share fell below `fall` of what it was."""
    old = before.select("archetype", F.col("demand_share").alias("before"))
    return now.join(old, "archetype").filter((F.col("before") > 0) & (F.col("demand_share") < F.col("before") * fall)).select("archetype", "before", "demand_share")


def filtered(jobs: DataFrame, role: str | None = None, work_model: str | None = None, stage: str | None = None, source: str | None = None, visa: bool = False) -> DataFrame:
    """Conjunctive filters; None, and the role all, filter nothing."""
    wanted = {"role_category": None if role == "all" else role, "work_model": work_model, "company_stage": stage, "source": source}
    conditions = [F.col(c) == v for c, v in wanted.items() if v is not None] + ([F.col("offers_sponsorship")] if visa else [])
    return reduce(lambda d, c: d.filter(c), conditions, jobs)


def top_skills_of(skills: DataFrame, k: int = 8) -> DataFrame:
    """Per posting its k most certain skills as one string."""
    order = Window.partitionBy("job_id").orderBy(F.desc("confidence"), "skill")
    best = skills.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return best.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "skill"))), lambda x: x["skill"]), ", ").alias("skills"))


def page(jobs: DataFrame, skills: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """One page of postings, newest first, each with its skills, and the counts of rows and pages.

    The page is cut before the skills are joined, so they are aggregated for its rows only.
    """
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("a page holds 1 to 100 rows and pages count from 1")
    found = filtered(jobs, **filters)
    total = found.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int"))
    rows = found.orderBy(F.desc("scraped_at"), "job_id").offset((number - 1) * size).limit(size)
    own = skills.join(F.broadcast(rows.select("job_id")), "job_id", "left_semi")  # at most 100 rows
    return rows.join(top_skills_of(own), "job_id", "left").crossJoin(total)


def unenriched(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    return jobs.join(skills.select("job_id").distinct(), "job_id", "left_anti")


def implied(jobs: DataFrame, skills: DataFrame, table: dict, confidence: float = 0.6) -> DataFrame:
    """Skills that a posting's role implies, for postings without any, or too short; those it has are left out."""
    rows = [(role, s, c) for role, found in table.items() for s, c in found]
    known = jobs.sparkSession.createDataFrame(rows, "role string, skill string, skill_category string")
    role = F.when(F.col("role_category").isin(*table), F.col("role_category")).otherwise("other")
    out = jobs.withColumn("role", role).join(F.broadcast(known), "role")  # a fixed list
    have = skills.select("job_id", F.lower("skill").alias("low")).distinct()
    return out.withColumn("low", F.lower("skill")).join(have, ["job_id", "low"], "left_anti").select("job_id", "skill", "skill_category", F.lit("role_inference").alias("extraction_method"), F.lit(confidence).alias("confidence"))


def gaps(ranked: DataFrame, have: DataFrame, k: int = 10, high: int = 50) -> DataFrame:
    """The first k skills in demand (skill, mentions) that are not in `have` (skill), whatever the case; high above `high` mentions."""
    missing = ranked.withColumn("low", F.lower("skill")).join(have.select(F.lower("skill").alias("low")), "low", "left_anti").drop("low")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mentions"), "skill")
    cut = missing.orderBy(F.desc("mentions"), "skill").limit(k)
    return cut.withColumn("priority", F.row_number().over(order)).withColumn("importance", F.when(F.col("mentions") > high, "high").otherwise("medium"))


def match_score(ranked: DataFrame, have: DataFrame, k: int = 10) -> DataFrame:
    """Share of the top k skills that are in `have`, rounded to 2 places."""
    best = ranked.orderBy(F.desc("mentions"), "skill").limit(k).select(F.lower("skill").alias("low"))
    hit = best.join(have.select(F.lower("skill").alias("low")).distinct().withColumn("hit", F.lit(1)), "low", "left")
    return hit.agg(F.round(F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 2).alias("match_score"))


def sector_fit_exact(people: DataFrame, sectors: dict) -> DataFrame:
    """Per person (id, skills array) and sector: per cent of the sector's words among the skills; above 0 only."""
    low = F.transform("skills", F.lower)
    rows = []
    for name, (words, rate) in sectors.items():
        score = F.round(F.size(F.array_intersect(low, F.array(*map(F.lit, words)))) / len(words) * 100, 1)
        rows.append(F.struct(F.lit(name).alias("sector"), score.alias("fit_score"), F.lit(rate).alias("sponsorship_rate")))
    return people.select("id", F.explode(F.array(*rows)).alias("s")).select("id", "s.*").filter("fit_score > 0")


def _holds(word: str):
    return lambda s: F.lower(s).contains(word)


def sector_fit_contained(people: DataFrame, sectors: dict, k: int = 3) -> DataFrame:
    """Per person the k sectors with most words contained in some skill; share rounded to 2 places."""
    rows = []
    for n, (name, words) in enumerate(sectors.items()):
        hits = sum(F.exists("skills", _holds(w)).cast("int") for w in words)
        rows.append(F.struct(F.lit(n).alias("n"), F.lit(name).alias("sector"), F.round(hits / len(words), 2).alias("fit_score")))
    order = lambda a, b: F.when(a["fit_score"] > b["fit_score"], -1).when(a["fit_score"] < b["fit_score"], 1).otherwise(a["n"] - b["n"])
    return people.select("id", F.explode(F.slice(F.array_sort(F.array(*rows), order), 1, k)).alias("s")).select("id", "s.sector", "s.fit_score")
