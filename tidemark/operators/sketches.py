"""Sketches by day that add up: quantiles and distinct counts of any span of days without rescanning its rows.

A day's rows leave a quantile sketch (KLL, its size set by K whatever the rows), a distinct-count sketch (HLL) and a count;
weeks and baselines are merges of days, and so are drift figures, which read ranks off two sketches. Figures are
approximate within the sketches' bounds: a rank to about 1.5 / K ** 0.9, a distinct count to about 1.04 / 2 ** (LOG / 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, LOG = 400, 14


def daily(rows: DataFrame, at: str, value: str, item: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """By key and day: n, quantiles (of value) and items (distinct item). A null value or item is in no sketch, NaN neither; a null time is no day.

    Partial sketches are built where the rows are, so a day or key with very many rows moves one small sketch a task.
    """
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    dated = rows.withColumns({"day": F.to_date(at), "_v": known, "_i": F.xxhash64(item)}).filter("day is not null")
    return dated.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", F.lit(K)).alias("quantiles"), F.hll_sketch_agg(F.when(F.col(item).isNotNull(), F.col("_i")), F.lit(LOG)).alias("items"))


def merged(days: DataFrame, keys: tuple[str | Column, ...] = ()) -> DataFrame:
    """Sketches of days, or of merges, put together by key."""
    return days.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("items").alias("items"))


def quantile(c: str | Column, rank: float) -> Column:
    """Null of an empty sketch."""
    return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(rank)))


def distinct(c: str | Column) -> Column:
    return F.hll_sketch_estimate(c)


def drift(baseline: DataFrame, current: DataFrame, bins: int = 10, least: float = 0.2) -> DataFrame:
    """Population stability of one merged row against another: bins of equal frequency in the baseline, their shares read off both sketches.

    psi and drifted; null and false where either has no values. An empty bin counts half a row. A value that the baseline holds very
    often ends several bins at once, which are one.
    """
    both = baseline.select(F.col("quantiles").alias("e")).crossJoin(current.select(F.col("quantiles").alias("a")))  # a row each
    told = baseline.select(F.array(*[quantile("quantiles", k / bins) for k in range(1, bins)])).first()  # a rank is asked for with a literal
    edges = sorted({x for x in (told[0] if told else []) if x is not None})
    n = lambda c: F.kll_sketch_get_n_double(c)

    def shares(c: str) -> Column:
        upto = [F.kll_sketch_get_rank_double(c, F.lit(x)) for x in edges] + [F.lit(1.0)]
        each = [upto[0], *[b - a for a, b in zip(upto, upto[1:])]]
        return F.array(*[F.greatest(x, 0.5 / n(c)) for x in each])

    terms = F.zip_with(shares("e"), shares("a"), lambda e, a: (a - e) * F.log(a / e))
    psi = F.when((n("e") > 0) & (n("a") > 0), F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 4))
    return both.select(psi.alias("psi")).withColumn("drifted", F.coalesce(F.col("psi") > least, F.lit(False)))
