"""Day cubes: additive counts by day from which the weekly figures are composed without rescanning postings.

A cell is (kind, day, role, item, other, value) and n, a count. Cells of sets of postings add up, so a change of
postings is a set of signed cells: those of the rows as they were, taken off, and of the rows as they are, put on.
A posting that is scraped again thus moves from its old day to the new one. The cells of a store
are kept in hash buckets of days (operators/keyed.py): a batch adds files to the buckets of the days it changes, a
reader of two weeks opens those of 14 days.

Kinds: facts (postings, fresh, sponsored, remote, hybrid, startup, mentions), skills, places (raw locations, made
canonical when read), pay (value: the exact midpoint, so percentiles are exact), companies; and, on postings with
skills, named (skill by posting; the empty item counts postings) and pairs (item before other).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import midpoint
from tidemark.operators import market as m
from tidemark.operators.keyed import KeyedStore, Merged

KEYS = ["kind", "day", "role", "item", "other", "value"]
#: What a posting's own columns give; what its skills give; what its pairs of skills give.
KINDS = ("postings", "skills", "pairs")
#: Files put beside a bucket before it is folded.
FILES = 64


def _cell(kind: str, item: Column, other: Column | None = None, value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"), (F.lit("") if other is None else other).alias("other"), (F.lit(None).cast("double") if value is None else value).alias("value"))


def _named(jobs: DataFrame, skills: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """KEYS and n of every cell that postings count in, not summed up; a skill is counted by day and role before it becomes two cells."""
    based = jobs.withColumns({"day": F.to_date("scraped_at"), "role": F.coalesce("role_category", F.lit("other"))})
    parts, one = [], F.lit(1).cast("long").alias("n")
    if "postings" in kinds:
        known = m.usable_pay()
        fresh = F.col("first_seen") >= F.date_trunc("week", F.col("scraped_at")) if "first_seen" in jobs.columns else F.lit(True)
        flags = {"postings": F.lit(True), "fresh": fresh, "sponsored": F.col("offers_sponsorship"), "remote": F.col("work_model") == "remote", "hybrid": F.col("work_model") == "hybrid", "startup": F.col("is_startup")}
        told = [F.when(c, _cell("facts", F.lit(name))) for name, c in flags.items()]
        told += [F.when(F.coalesce("location", F.lit("")) != "", _cell("places", F.col("location"))), F.when(F.col("company").isNotNull(), _cell("companies", F.col("company")))]
        told += [F.when(known, _cell("pay", F.lit(""), value=midpoint(F.col("salary_min"), F.col("salary_max")).cast("double")))]
        parts.append(based.select("day", "role", F.explode(F.array(*told)).alias("c"), one).filter("c is not null"))  # a lambda over the array would not be compiled
    days = based.select("job_id", "day", "role")
    if "skills" in kinds:
        named = skills.select("job_id", "skill").join(days, "job_id").groupBy("day", "role", "skill").agg(F.count("*").alias("n"))
        parts.append(named.select("day", "role", F.explode(F.array(_cell("skills", F.col("skill")), _cell("facts", F.lit("mentions")))).alias("c"), "n"))
    if "pairs" in kinds:
        sets = skills.select("job_id", "skill").join(days, "job_id").groupBy("job_id", "day", "role").agg(F.array_sort(F.collect_set("skill")).alias("s"))
        inner = lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: _cell("pairs", x, y))
        singles = F.transform(F.array_append("s", ""), lambda x: _cell("named", x))
        parts.append(sets.select("day", "role", F.explode(F.concat(singles, F.flatten(F.transform("s", inner)))).alias("c"), one))
    return reduce(DataFrame.unionByName, parts).select("day", "role", "c.*", "n").select(*KEYS, "n")


def cells(jobs: DataFrame, skills: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Cells of postings (each once) and their skills: KEYS and n. Postings are read once for each of `kinds`, skills once for each of the last two.

    A null role is other; a null or empty place, a null company and pay that cannot be used give no cell.
    """
    return _named(jobs, skills, kinds).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells that are summed up; those of 0 go."""
    return summed(old.select(*KEYS, "n").unionByName(new.select(*KEYS, "n")))


def summed(cells_: DataFrame) -> DataFrame:
    """One cell of each KEYS; those of 0 go."""
    return cells_.groupBy(*KEYS).agg(F.sum("n").alias("n")).filter("n <> 0")


def changes(before: DataFrame, after: DataFrame, skills_before: DataFrame, skills_after: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Signed cells of a change of postings: as they were (with no row where a posting is new) and as they are (none where it goes)."""
    off, on = _named(before, skills_before, kinds), _named(after, skills_after if skills_after is not None else skills_before, kinds)
    return added(on, off.withColumn("n", -F.col("n")))


class DayCube:
    """The cells of all postings in a keyed store by day.

    A batch is written beside the cells it changes, and the reader sums up; a bucket is folded once what was put beside it
    outgrows it. So a batch costs as much as it holds, and the cube at most some times what was put into it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = KeyedStore(spark, path)

    @classmethod
    def create(cls, path: str, jobs: DataFrame, skills: DataFrame, kinds: tuple[str, ...] = KINDS, buckets: int = 64) -> DayCube:
        KeyedStore.create(path, cells(jobs, skills, kinds), ["day"], buckets)
        return cls(jobs.sparkSession, path)

    def apply(self, signed: DataFrame, run: str | None = None, number: int = 0) -> Merged | None:
        """Put a batch of `changes` in force; a run's number counts once."""
        done = self.store.append(signed, run, number)
        if done:
            self.store.fold(summed, FILES)
        return done

    def days(self, since: str, until: str) -> DataFrame:
        """Cells of the days from since to before until; only the buckets of these days are opened."""
        spark = self.store.spark
        wanted = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.date_sub(F.lit(until).cast("date"), 1))).alias("day"))
        return summed(self.store.touched_by(wanted).filter((F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date"))))


# --- what is composed of cells ------------------------------------------------------------------------------------


def _at(week: str, days: int = 0) -> Column:
    return F.date_add(F.lit(week).cast("date"), days)


def snapshot(cube: DataFrame, week: str, k: int = 50, patterns=m.CITIES, cities: int = 20, now: Column | None = None) -> DataFrame:
    """The weekly snapshot of `market.snapshot` out of the cells of the week and the one before.

    All roles and each role come from one aggregation, lists and facts from another over its ranked rows; the pay
    histogram is read for itself.
    """
    both = cube.filter((F.col("day") >= _at(week, -7)) & (F.col("day") < _at(week, 7)))
    place = F.when(F.col("kind") == "places", m.canonical_place(F.col("item"), patterns)).otherwise(F.col("item"))
    here = F.col("day") >= _at(week)
    wide = both.filter(F.col("kind").isin("facts", "skills", "places")).select("kind", place.alias("item"), F.explode(F.array("role", F.lit("all"))).alias("role"), F.when(here, F.col("n")).otherwise(0).alias("n"), F.when(here, 0).otherwise(F.col("n")).alias("o"))
    summed = wide.groupBy("kind", "role", "item").agg(F.sum("n").alias("n"), F.sum("o").alias("before")).filter("n > 0")
    order = Window.partitionBy("kind", "role").orderBy(F.desc("n"), "item")
    ranked = summed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(k, 50, cities))
    change = F.when(F.col("before") > 0, (F.col("n") - F.col("before")) / F.col("before"))
    up = (change > 0.5) | ((F.col("before") == 0) & (F.col("n") > 5))
    fact = lambda name: F.coalesce(F.max(F.when((F.col("kind") == "facts") & (F.col("item") == name), F.col("n"))), F.lit(0))
    listed = lambda c, *x: F.array_sort(F.collect_list(F.when(c, F.struct("r", *x))))
    skill = F.col("kind") == "skills"
    moving = lambda c: F.slice(F.transform(listed(skill & (F.col("r") <= 50) & c, F.col("item")), lambda x: x["item"]), 1, 20)
    out = ranked.groupBy("role").agg(
        fact("postings").alias("job_count"), fact("fresh").alias("new_job_count"),
        *[F.round(fact(name) / fact("postings"), 4).alias(f"{rate}_rate") for name, rate in (("sponsored", "sponsorship"), ("remote", "remote"), ("hybrid", "hybrid"), ("startup", "startup"))],
        fact("mentions").alias("skill_mentions"), listed(skill & (F.col("r") <= k), F.col("item").alias("skill"), F.col("n")).alias("top_skills"), moving(up).alias("rising_skills"), moving(change < -0.3).alias("declining_skills"),
        F.transform(listed((F.col("kind") == "places") & (F.col("r") <= cities), F.col("item").alias("place"), F.col("n")), lambda x: F.struct(x["place"], x["n"])).alias("top_cities"),
    ).filter("job_count > 0")
    bare = lambda c, empty: F.when(empty, None).otherwise(F.col(c))
    out = out.withColumns({c: bare(c, F.size("top_skills") == 0) for c in ("skill_mentions", "rising_skills", "declining_skills")} | {"top_skills": bare("top_skills", F.size("top_skills") == 0), "top_cities": bare("top_cities", F.size("top_cities") == 0)})
    pay = both.filter(here & (F.col("kind") == "pay") & F.col("value").between(20000, 300000)).select(F.explode(F.array("role", F.lit("all"))).alias("role"), F.col("value").alias("mid"), "n")
    pay = m.percentiles(pay, "mid", ("role",), weight="n")
    pay = pay.select("role", F.col("sample_size").alias("salary_sample_size"), *[F.col(f"p{p}").alias(f"salary_p{p}") for p in m.PERCENTS])
    out = out.join(pay, "role", "left").withColumnRenamed("role", "role_category").withColumn("salary_sample_size", F.coalesce("salary_sample_size", F.lit(0)))
    out = out.withColumn("disclosure_rate", F.round(F.col("salary_sample_size") / F.col("job_count"), 3))
    return out.withColumns({"week_start": F.lit(week).cast("date"), "computed_at": now if now is not None else F.current_timestamp()})


def salary_ladder(cube: DataFrame, week: str, days: tuple[int, ...] = (7, 30, 90), least: int = 5) -> DataFrame:
    """`market.salary_ladder` out of cells: the first window with `least` usable rows, its percentiles and disclosure."""
    step = reduce(lambda out, n: F.when(F.col("day") >= _at(week, 7 - days[n]), n).otherwise(out), reversed(range(len(days))), F.lit(len(days)))
    near = cube.filter((F.col("day") < _at(week, 7)) & (F.col("day") >= _at(week, 7 - days[-1]))).withColumn("_step", step)
    sums = near.filter("kind = 'pay' or (kind = 'facts' and item = 'postings')").groupBy("_step").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind) for kind in ("pay", "facts")])
    upto = lambda kind, n: F.coalesce(F.sum(F.when(F.col("_step") <= n, F.col(kind))), F.lit(0))
    one = sums.agg(*[upto("pay", n).alias(f"n{n}") for n in range(len(days))], *[upto("facts", n).alias(f"t{n}") for n in range(len(days))])
    pick = lambda c: reduce(lambda out, n: F.when(F.col(f"n{n}") >= least, c(n)).otherwise(out), reversed(range(len(days))), c(len(days) - 1))
    chosen = one.select(pick(F.lit).alias("_chosen"), pick(lambda n: F.col(f"t{n}")).alias("total"))
    inside = near.filter((F.col("kind") == "pay") & F.col("value").between(20000, 300000)).join(F.broadcast(chosen), F.col("_step") <= F.col("_chosen"))  # one row is broadcast
    found = m.percentiles(inside.select(F.col("value").alias("mid"), "n"), "mid", least=least, weight="n")
    window = F.element_at(F.array(*map(F.lit, days)), F.col("_chosen") + 1)
    return found.crossJoin(chosen).select(*[f"p{p}" for p in m.PERCENTS], "sample_size", F.round(F.col("sample_size") / F.greatest("total", F.lit(1)), 3).alias("disclosure_rate"), window.alias("window_days"))  # a row each


def momentum(cube: DataFrame, week: str, k: int = 20, weights=(1.0, 0.6, 0.3)) -> DataFrame:
    """`market.momentum` out of cells."""
    near = cube.filter((F.col("kind") == "companies") & (F.col("day") >= _at(week, -14)) & (F.col("day") < _at(week, 7)))
    in_week = lambda b: (F.col("day") >= _at(week, -7 * b)) & (F.col("day") < _at(week, 7 - 7 * b))
    weeks = [F.coalesce(F.sum(F.when(in_week(b), F.col("n"))), F.lit(0)).alias(f"w{b}") for b in range(3)]
    score = F.round(sum(F.lit(w) * F.col(f"w{b}") for b, w in enumerate(weights)), 2)
    return near.groupBy(F.col("item").alias("company")).agg(*weeks).withColumn("momentum", score).filter("momentum > 0").orderBy(F.desc("momentum"), "company").limit(k)


def role_velocity(cube: DataFrame, since: str, until: str) -> DataFrame:
    """Postings by role from since to before until."""
    facts = cube.filter((F.col("kind") == "facts") & (F.col("item") == "postings") & (F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date")))
    return facts.groupBy("role").agg(F.sum("n").alias("postings"))


def cooccurrence(cube: DataFrame, since: str, until: str, k: int = 200, least: int = 3) -> DataFrame:
    """`market.cooccurrence` out of cells: no pair of skills is formed again."""
    near = cube.filter((F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date")) & F.col("kind").isin("named", "pairs"))
    pairs = near.filter("kind = 'pairs'").groupBy(F.col("item").alias("skill_a"), F.col("other").alias("skill_b")).agg(F.sum("n").alias("co_count")).filter(F.col("co_count") >= least)
    named = near.filter("kind = 'named'").groupBy("item").agg(F.sum("n").alias("n"))
    total = named.filter("item = ''").select(F.col("n").alias("total"))
    end = lambda c, n: named.filter("item <> ''").select(F.col("item").alias(c), F.col("n").alias(n))
    met = pairs.join(end("skill_a", "na"), "skill_a").join(end("skill_b", "nb"), "skill_b")
    pmi = F.round(F.log(F.col("co_count").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb"))), 4)
    return met.crossJoin(F.broadcast(total)).withColumn("pmi", pmi).filter("pmi > 0").select("skill_a", "skill_b", "pmi", "co_count").orderBy(F.desc("pmi"), F.desc("co_count"), "skill_a", "skill_b").limit(k)  # one row is broadcast
