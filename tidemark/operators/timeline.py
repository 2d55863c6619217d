"""Scans along each key's time line that no key's length bounds: a third of all rows may have one key.

All rows are put in order of key and time and cut into slices of like numbers of rows, so a long time line spans
many. Each slice is scanned for itself and leaves one state a key (a sum, a last value); a scan over these states, of
which a key has at most one a slice, tells each slice what came before it, and slices finish alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import write_table


def sliced(rows: DataFrame, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """rows with their slice (_slice), in a table of the shared folder. order: columns that put a key's rows in one order (ties are parted anyhow)."""
    count = slices or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, key, *order)
    return write_table(dealt.withColumn("_slice", F.spark_partition_id()), "slices")


def _with_states(rows: DataFrame, states: DataFrame, key: str) -> DataFrame:
    told = states.withColumnsRenamed({key: "_key", "_slice": "_of"})
    return rows.join(told, (F.col("_slice") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_key", "_of")


def running(rows: DataFrame, key: str, order: list[str], name: str, value: Column) -> DataFrame:
    """rows of `sliced` with the sum of value over the key's rows up to each, itself included."""
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy("_slice", key).agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    states = sums.select("_slice", key, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_slice", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _with_states(rows.withColumn("_own", own), states, key).withColumn(name, F.col("_before") + F.col("_own")).drop("_value", "_own", "_before")


def previous(rows: DataFrame, key: str, order: list[str], name: str, column: str) -> DataFrame:
    """rows of `sliced` with the column's value in the key's row before, null in its first."""
    ends = rows.groupBy("_slice", key).agg(F.max_by(column, F.struct(*order)).alias("_last"))
    states = ends.select("_slice", key, F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")).alias("_before"))
    line = Window.partitionBy("_slice", key).orderBy(*order)
    told = rows.withColumns({"_own": F.lag(column).over(line), "_first": F.row_number().over(line) == 1})
    return _with_states(told, states, key).withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own"))).drop("_own", "_first", "_before")


def hits_before(events: DataFrame, key: str, at: str, micros: int, slices: int | None = None) -> DataFrame:
    """events with n, how many of the key's events lie in the `micros` microseconds before each (those of its own instant do not count).

    at: microseconds. Per event the hits before it, less those before its window, both read off one running count
    along the time line: the event itself is a step, and it asks at its own time and at its window's start. Events that
    repeat count each; a null key is a key, an event without a time has no hits and is none.
    """
    numbered = events.withColumn("_id", F.monotonically_increasing_id())
    known = write_table(numbered, "events")
    step = lambda t, kind, sign: F.struct(t.alias("_at"), F.lit(kind).alias("_kind"), F.lit(sign).alias("_sign"))  # noqa: E731 - at one time, who asks comes first
    rows = known.filter(F.col(at).isNotNull()).select("_id", F.col(key).alias("_k"), F.explode(F.array(step(F.col(at), 0, 1), step(F.col(at) - micros, 0, -1), step(F.col(at), 1, 0))).alias("s")).select("_id", "_k", "s.*")
    order = ["_at", "_kind", "_id", "_sign"]
    counted = running(sliced(rows, "_k", order, slices), "_k", order, "_n", F.col("_kind"))
    hits = counted.filter("_kind = 0").groupBy("_id").agg(F.sum(F.col("_sign") * F.col("_n")).alias("n"))
    return known.join(hits, "_id", "left").drop("_id").withColumn("n", F.coalesce("n", F.lit(0)))


def sessions(events: DataFrame, key: str, at: str, tie: str, micros: int, slices: int | None = None) -> DataFrame:
    """events (with at, microseconds) with session: from 1 on, a new one after more than `micros` without an event of the key."""
    order = [at, tie]
    rows = previous(sliced(events, key, order, slices), key, order, "_prev", at)
    return running(rows, key, order, "session", F.coalesce(F.col(at) - F.col("_prev") > micros, F.lit(True)).cast("long")).drop("_prev", "_slice")
