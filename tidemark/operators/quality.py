"""Data-quality and drift checks, each one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def integrity(df: DataFrame, required: tuple[str, ...], value: str, low: float, high: float, keys: tuple[str, ...], text: str, shortest: int) -> DataFrame:
    """Null rates, values out of range, copies by key, and short texts, in one aggregation (a second one counts keys)."""
    rates = [F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"null_{c}") for c in required]
    one = df.agg(F.count("*").alias("total_rows"), *rates, F.count_if(~F.col(value).between(low, high)).alias("out_of_range"), F.count_if(F.length(F.coalesce(text, F.lit(""))) < shortest).alias("short_texts"))
    copies = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies"))
    return one.crossJoin(copies)  # a row each


def posting_integrity(jobs: DataFrame, skills: DataFrame, now: Column, low: float = 10000, high: float = 600000) -> DataFrame:
    """One row of checks: null rates of company, role and pay, pay out of range or with its minimum above its maximum, dates after now,
    copies (of one company, role, place and day), and skills whose posting is not there."""
    rate = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    null = lambda c: F.col(c).isNull()
    outside = lambda c: F.coalesce(~F.col(c).between(low, high), F.lit(False))
    one = jobs.agg(
        F.count("*").alias("total_rows"), rate(null("company"), "null_company"), rate(null("role_category"), "null_role"), rate(null("salary_min") & null("salary_max"), "null_salary"),
        F.count_if(outside("salary_min") | outside("salary_max")).alias("salary_out_of_range"), F.count_if(F.col("salary_min") > F.col("salary_max")).alias("salary_crossed"), F.count_if(F.col("scraped_at") > now).alias("future_dates"),
    )
    copies = jobs.groupBy("company", F.coalesce("role_category", F.lit("")).alias("r"), "location", F.to_date("scraped_at").alias("d")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies"))
    orphans = skills.join(jobs.select("job_id"), "job_id", "left_anti").agg(F.count("*").alias("orphan_skills"))
    return one.crossJoin(copies).crossJoin(orphans)  # a row each


def psi(expected: DataFrame, actual: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Population stability index over equal-width bins: sum of (a - e) ln(a / e), empty bins as half a row."""
    binned = lambda df, n: df.filter(F.col(column).isNotNull()).groupBy(F.least(F.greatest(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias(n))
    every = expected.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    met = every.join(binned(expected, "e"), "bin", "left").join(binned(actual, "a"), "bin", "left")
    counts = met.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in "ea"])
    total = counts.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    share_e, share_a = F.col("e") / F.col("te"), F.col("a") / F.col("ta")
    value = F.round(F.sum((share_a - share_e) * F.log(share_a / share_e)), 6)
    return counts.crossJoin(F.broadcast(total)).agg(value.alias("psi")).withColumn("drifted", F.col("psi") > 0.2)


def gate(df: DataFrame, health: str, batch: str, drift: str) -> DataFrame:
    """Per row of maps (name to figure): mean health over 0.7, mean batch over 0.8, largest drift below 0.2, and all of them."""
    mean = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(F.map_values(m)), F.lit(1))
    out = df.withColumns({"health_ok": mean(health) > 0.7, "batch_ok": mean(batch) > 0.8, "drift_ok": F.coalesce(F.array_max(F.map_values(drift)), F.lit(0.0)) < 0.2})
    return out.withColumn("passed", F.col("health_ok") & F.col("batch_ok") & F.col("drift_ok"))


def ops_status(df: DataFrame) -> DataFrame:
    """cost_over, pipeline_failed, infra_down (booleans): the issues, and poor, warning or good."""
    issues = F.array_compact(F.array(F.when(F.col("cost_over"), "COST_OVERRUN"), F.when(F.col("pipeline_failed"), "PIPELINE_FAILURE"), F.when(F.col("infra_down"), "INFRA_DEGRADED")))
    poor = F.exists(issues, lambda i: i.rlike("FAILURE|OVERRUN"))
    return df.withColumn("issues", issues).withColumn("status", F.when(poor, "poor").when(F.size(issues) > 0, "warning").otherwise("good"))


def cost_alerts(costs: DataFrame, key: str, period: str, cost: str, back: int = 4, times: float = 2.0) -> DataFrame:
    """Periods that cost over `times` the mean of the `back` before."""
    before = Window.partitionBy(key).orderBy(period).rowsBetween(-back, -1)
    out = costs.withColumn("usual", F.round(F.avg(cost).over(before), 4))
    return out.withColumn("over", F.coalesce(F.col(cost) > times * F.col("usual"), F.lit(False)))


def monotone(df: DataFrame, low: str, mid: str, high: str) -> Column:
    """Percentiles in order, where known."""
    return F.coalesce((F.col(low) <= F.col(mid)) & (F.col(mid) <= F.col(high)), F.lit(True))


def snapshot_quality(df: DataFrame) -> DataFrame:
    """poor below 10 postings, warning without skills, or where pay is not in order or disclosed below 0.25."""
    bad = F.when(F.col("job_count") < 10, "poor").when(F.coalesce(F.size("top_skills"), F.lit(0)) <= 0, "warning").when(~monotone(df, "salary_p25", "salary_p50", "salary_p75"), "warning")
    bad = bad.when(F.col("disclosure_rate") < 0.25, "warning")
    return df.withColumn("quality", F.coalesce(bad, F.lit("good")))
