"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows (one in so many) is spread; so there are at most as many such keys.
SHARE = 1000


def hot_keys(counts: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """Keys with over a thousandth of `total` rows, and into how many parts to spread each. At most SHARE rows."""
    each = max(1, total // SHARE)
    return counts.filter(F.col(n) > each).select(F.col(key).alias("_hot"), F.ceil(F.col(n) / each).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner", hint: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """left joined with right on key; rows of hot keys are dealt to parts by their columns `by` (all), and right's rows repeated for each part.

    How often right's rows are repeated sums up to 2 * SHARE at most where right has one row a key. how: inner or left.
    A null key meets nothing.
    """
    told = F.broadcast(hot)  # at most SHARE rows
    salt = F.pmod(F.xxhash64(*(by or left.columns)), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = left.join(told, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    spread = right.join(told, F.col(key) == F.col("_hot"), "left").withColumn("_salt", parts).drop("_hot", "_salts")
    if hint:
        spread = spread.hint(hint)
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def sized_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """salted_join where both sides know, as column n, how many rows left has of the key: no hot list is needed."""
    salts = F.greatest(F.lit(1), F.ceil(F.col(n) / max(1, total // SHARE))).cast("int")
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def with_group(rows: DataFrame, key: str, total: int, **sums) -> DataFrame:
    """rows with aggregates over their key (and n, its rows); total: how many rows there are."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in sums.items()])
    return salted_join(rows, groups, key, hot_keys(groups, key, total))
