"""Skill vectors: the positive pointwise mutual information of skills, factored by a distributed randomised decomposition.

The matrix is a table of pairs. A product with a thin block of vectors (a row a skill) is a join and a sum by skill; the block is made
orthonormal by its Gram matrix, which is small; a few rounds turn random vectors, drawn from the skills' hashes, into the leading
eigenvectors of the symmetric matrix. Nothing but Gram matrices of RANK + MORE columns leaves the tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import drop_table, write_table

RANK, MORE, ROUNDS = 16, 8, 6
#: Where a market has nothing to hold a person against: per cent, and shares of strong, moderate and weak.
UNKNOWN = (50.0, 0.3, 0.4, 0.3)


def ppmi(rows: DataFrame) -> DataFrame:
    """rows: job_id, skill. a, b, x: above-zero mutual information of skills in postings, both ways and of each with itself. A posting's skills are few."""
    sets = rows.filter("job_id is not null and skill is not null").groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x: F.transform("s", lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    counted = write_table(pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")), "pairs")
    single = counted.filter("a = b").select(F.col("a").alias("skill"), "n")
    total = sets.agg(F.count("*").alias("total"))
    met = counted.join(single.toDF("a", "na"), "a").join(single.toDF("b", "nb"), "b").crossJoin(F.broadcast(total))  # one row
    x = F.log(F.col("n").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    out = write_table(met.select("a", "b", x.alias("x")).filter("x > 0"), "ppmi")
    drop_table(counted)
    return out


def _dot(block: DataFrame, columns: np.ndarray) -> DataFrame:
    """Every row's vector times a small matrix."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) @ columns
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["skill", "v"])

    return block.select("skill", "v").mapInArrow(run, "skill string, v array<double>")


def _gram(block: DataFrame, width: int, other: str = "v") -> np.ndarray:
    """The sum over rows of v' times the other vector: a small matrix, of which each task makes its part."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                v, w = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, width) for c in range(2))
                total += v.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = block.select("v", F.col(other).alias("w")).mapInArrow(run, "part binary").collect()  # a row a task
    return sum((np.frombuffer(r.part).reshape(width, width) for r in parts), np.zeros((width, width)))


def _product(matrix: DataFrame, block: DataFrame, width: int) -> DataFrame:
    met = matrix.join(block.withColumnRenamed("skill", "b"), "b")
    return met.groupBy(F.col("a").alias("skill")).agg(F.array(*[F.sum(F.col("x") * F.col("v")[i]) for i in range(width)]).alias("v"))


def _orthonormal(block: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The block's span, without directions that are nothing but rounding."""
    for _ in range(2):  # the second time takes off what rounding left
        values, turn = np.linalg.eigh(_gram(block, width))
        on = values > values.max(initial=0.0) * 1e-12
        if not on.any():
            return block, 0
        block, width = write_table(_dot(block, turn[:, on] / np.sqrt(values[on])), "block"), int(on.sum())
    return block, width


def vectors(matrix: DataFrame, rank: int = RANK, rounds: int = ROUNDS) -> DataFrame:
    """skill, v: eigenvectors of the `rank` eigenvalues of largest size, each scaled by the root of its size. matrix: of `ppmi`.

    Products of two are the matrix's best approximation of that rank (where its eigenvalues are not negative). No pairs give no skills.
    """
    skills = matrix.select(F.col("a").alias("skill")).distinct()
    count = skills.count()
    width = min(rank + MORE, count)
    if not count:
        return matrix.sparkSession.createDataFrame([], "skill string, v array<double>")
    unit = lambda n: (F.pmod(F.xxhash64("skill", F.lit(n)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = [F.sqrt(-2 * F.log(unit(2 * i))) * F.cos(2 * np.pi * unit(2 * i + 1)) for i in range(width)]
    block, width = _orthonormal(skills.select("skill", F.array(*normal).alias("v")), width)
    for _ in range(rounds):
        block, width = _orthonormal(write_table(_product(matrix, block, width), "product"), width)
        if not width:
            return skills.select("skill", F.array().cast("array<double>").alias("v"))
    both = block.join(_product(matrix, block, width).withColumnRenamed("v", "w"), "skill")
    small = _gram(both, width, "w")
    values, turn = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-np.abs(values), kind="stable")[:rank]
    return _dot(block, turn[:, first] * np.sqrt(np.abs(values[first])))


def means(rows: DataFrame, key: str, known: DataFrame, rank: int) -> DataFrame:
    """key, v: the mean of the vectors of a key's distinct skills; keys without a known one are left out."""
    met = rows.select(key, "skill").distinct().join(known, "skill")
    return met.groupBy(key).agg(F.array(*[F.avg(F.col("v")[i]) for i in range(rank)]).alias("v"))


def market_match(people: DataFrame, postings: DataFrame, rows: DataFrame, known: DataFrame, rank: int, least: int = 20) -> DataFrame:
    """Per person (id, skill): match_pct and the shares strong, moderate and weak of the postings (job_id) by the cosine of mean skill vectors.

    rows: job_id, skill. Fewer than `least` postings, or a person without a known skill, give the figures of UNKNOWN.
    Persons of the same skills are held against the postings once, so most of the work is by distinct sets of skills.
    """
    sets = people.groupBy("id").agg(F.array_sort(F.collect_set("skill")).alias("own")).withColumn("own", F.when(F.col("id").isNotNull(), F.col("own")).otherwise(F.array().cast("array<string>")))
    have = means(sets.select("own").distinct().select("own", F.explode("own").alias("skill")), "own", known, rank)
    held = means(rows.join(postings.select("job_id").distinct(), "job_id", "left_semi"), "job_id", known, rank)
    enough = held.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).filter(F.col("_n") >= least)  # the sample of postings, some hundred
    by = lambda a, b: reduce(lambda out, i: out + F.col(a)[i] * F.col(b)[i], range(rank), F.lit(0.0))  # noqa: E731 - unrolled, so that it is compiled
    enough = enough.select("v", by("v", "v").alias("vv"))
    near = have.withColumnRenamed("v", "mine").withColumn("mm", by("mine", "mine")).crossJoin(F.broadcast(enough))
    near = near.select("own", F.coalesce(F.try_divide(by("mine", "v"), F.sqrt(F.col("mm") * F.col("vv"))), F.lit(0.0)).alias("s"))
    s = F.round("s", 9)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    percent = F.round(F.least(F.greatest(F.avg("s") * 100, F.lit(0.0)), F.lit(100.0)), 1)
    found = near.groupBy("own").agg(percent.alias("match_pct"), share(s > 0.75).alias("strong"), share((s > 0.55) & (s <= 0.75)).alias("moderate"), share(s <= 0.55).alias("weak"))
    every = sets.join(found, "own", "left")
    return every.select("id", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(("match_pct", "strong", "moderate", "weak"), UNKNOWN)])
