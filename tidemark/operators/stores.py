"""Store protocols as set-based merges over DataFrames: old state and a batch in, new state out.

Parquet has no MERGE; each protocol is one aggregation or join, whose result is written beside what is
being read, so nothing is overwritten while it is read. Only the weekly snapshot, whose partitions are
whole weeks, uses dynamic partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_first_wins(old: DataFrame, new: DataFrame, key: str, refreshed: tuple[str, ...]) -> DataFrame:
    """Insert unknown keys; of known ones only the refreshed columns change. Of copies in the batch the first by all columns holds."""
    one = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("n"))
    joined = old.withColumn("_old", F.lit(True)).join(one, key, "full_outer")
    pick = lambda c: F.when(F.col("_old") & F.col("n").isNotNull() & F.lit(c in refreshed), F.col(f"n.{c}")).when(F.col("_old"), F.col(c)).otherwise(F.col(f"n.{c}"))
    return joined.select(key, *[pick(c).alias(c) for c in old.columns if c != key])


def touch(rows: DataFrame, keys: DataFrame, key: str, column: str, now: Column) -> DataFrame:
    """Set the column to now on rows whose key is listed."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), now).otherwise(F.col(column))).drop("_hit")


def append_unknown(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-ignore: rows of keys that are not there yet, one a key (the least by all columns)."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("n")).select(*keys, "n.*") if rest else new.select(*keys).distinct()
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Last write per key; ties by all other columns."""
    rest = [c for c in rows.columns if c not in keys and c != by]
    return rows.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("r")).select(*keys, "r.*")


def mark_seen(seen: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """seen: dedup_hash, first_seen, last_seen, times_seen; batch: dedup_hash. One aggregation over both."""
    fresh = batch.select("dedup_hash", now.alias("first_seen"), now.alias("last_seen"), F.lit(1).cast("long").alias("times_seen"))
    return seen.select(*fresh.columns).unionByName(fresh).groupBy("dedup_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))


def filter_new(batch: DataFrame, seen: DataFrame, now: Column, order: list[Column], days: int = 30) -> DataFrame:
    """Rows whose hash is not seen within `days`; of several in the batch the first by order. What is dropped does not refresh the store."""
    alive = seen.filter(F.col("last_seen") > now - F.expr(f"interval {days} days")).select("dedup_hash")
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy("dedup_hash").orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(alive, "dedup_hash", "left_anti")


def runs(log: DataFrame) -> DataFrame:
    """State of each run from its append-only events (run_id, at, status, and figures that later events fill in)."""
    rest = [c for c in log.columns if c not in ("run_id", "at")]
    ends = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in rest]
    return log.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("completed_at"), *ends)


def load_state(states: DataFrame, agents: DataFrame) -> DataFrame:
    """Every agent's latest state; a default where there is none."""
    out = agents.select("agent_id").distinct().join(states, "agent_id", "left")
    return out.withColumns({"run_count": F.coalesce("run_count", F.lit(0)), "consecutive_failures": F.coalesce("consecutive_failures", F.lit(0)), "adaptive_params": F.coalesce("adaptive_params", F.lit("{}"))})


def save_state(states: DataFrame, new: DataFrame, by: str = "updated_at") -> DataFrame:
    """Every agent's state after a save: the latest by `by`; of equal times the greatest by the other columns."""
    return latest(states.unionByName(new), ["agent_id"], by)


def params(c: Column) -> Column:
    """A state's JSON as a map of strings; no JSON, or none, is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def last_entries(log: Column, entry: Column, k: int) -> Column:
    """The array with one more entry, cut to its last k."""
    longer = F.concat(F.coalesce(log, F.array()), F.array(entry))
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - (k - 1)), k)


def yields_after(states: DataFrame, counts: DataFrame) -> DataFrame:
    """Per source: moving average 0.7 old + 0.3 new (old 1 if none), last four yields, and whether three in a row were nothing."""
    out = states.join(counts.select("source", F.col("n").alias("count")), "source", "full_outer").withColumn("count", F.coalesce("count", F.lit(0)))
    history = last_entries(F.col("history"), F.col("count").cast("long"), 4)
    out = out.select("source", F.round(0.7 * F.coalesce("ema", F.lit(1.0)) + 0.3 * F.col("count"), 2).alias("ema"), history.alias("history"))
    last3 = F.slice("history", F.greatest(F.lit(1), F.size("history") - 2), 3)
    return out.withColumn("disabled", (F.size("history") >= 3) & F.forall(last3, lambda y: y == 0))


def active_sources(states: DataFrame) -> DataFrame:
    return states.filter(~F.col("disabled")).select("source")


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.coalesce(F.col(column), value))


def save_weeks(df: DataFrame, path: str, by: str = "week_start") -> None:
    """Replace exactly the weeks that df holds; other weeks stay."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def trends(skills: DataFrame, total: Column) -> DataFrame:
    """Share of postings by skill, rounded to 6 places; nothing where there are no postings."""
    return skills.withColumn("pct_of_jobs", F.round(F.col("mentions") / total, 6)).filter(total > 0)


def expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") <= now)
