"""Exact top-k search by inner product over a pivot-distance index (iDistance).

Integer vectors gain one coordinate, the root of (largest squared norm - own squared norm), so all
have one norm and the largest inner product is the least distance. Each is keyed by its nearest pivot
and its distance from it; a pivot's vectors are cut into annuli of similar counts. By the triangle
inequality a query at distance dq from a pivot is at least dq - d_max or d_min - dq from all of an
annulus, which bounds every score there. A query visits annuli in the order of that bound, in three
rounds, and stops where no bound reaches its k-th best score so far; equal bounds are visited, for ties.
A round moves only the blocks of vectors that some query visits.

Every vector is indexed and the answer is exact; only the pivots come from a bounded sample (`sample`
vectors of least hash). Pivots and annuli grow with the vectors, to a catalogue that each task can hold
(an eighth of the sample times MOST_ANNULI); beyond it annuli are searched in more blocks. Equal vectors are folded first and keep their k + 1 least ids: more can never
be among k answers. An annulus is searched in blocks of at most about `block` vectors against as many
queries, so neither a common vector nor a common query gathers in one task.

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a null
id take no part; vectors of different lengths meet as if zeros followed the shorter; equal rows count
once, and a query never finds its own id; scores that leave 64 bits raise an error. Without other
rows a query has no answer. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, map_batches, table, write_table

SAMPLE, BLOCK = 2048, 2048
LEAST_ANNULI, MOST_ANNULI = 4, 64
#: Annuli visited in the first rounds; the last round takes what the bounds leave.
ROUNDS = (2, 8)
SCALE = 256


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of long): floor(256 * x) of every component; unusable vectors left out."""
    out = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("id is not null and x is not null")
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return out.filter(finite).select("id", F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def layout(count: int, sample: int = SAMPLE, block: int = BLOCK) -> tuple[int, int]:
    """Pivots and annuli a pivot for so many vectors."""
    pivots = max(1, min(sample // 8, round(count**0.5 / 8)))
    return pivots, min(MOST_ANNULI, max(LEAST_ANNULI, -(-count // (pivots * block))))


class Space:
    """The augmented space: pivots, the common squared norm, and the distances to the pivots."""

    def __init__(self, sample: list, width: int, norm: float, pivots: int):
        self.width, self.norm = width, norm
        points = self.lifted(_matrix(sample, width))
        centres = points[:pivots].copy()
        for _ in range(4):
            near = self._distances(points, centres).argmin(1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = points[near == c].mean(0)
        self.centres = centres

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))))

    def _distances(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0))

    def data(self, x: np.ndarray) -> np.ndarray:
        return self._distances(self.lifted(x), self.centres)

    def query(self, x: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack((x, np.zeros(len(x)))), self.centres)

    def bound(self, x: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Above every score of each query (rows) in each annulus (columns)."""
        d = self.query(x)[:, pivot]
        gap = np.maximum(np.maximum(d - high, low - d), 0)
        size = (x * x).sum(1)[:, None] + self.norm
        return (size - gap * gap) / 2 + 1e-7 * (1 + size)


def exact_scores(q: list, x: list, width: int) -> np.ndarray:
    a, b = _matrix(q, width), _matrix(x, width)
    if width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**52:
        return (a @ b.T).astype(np.int64)  # every partial sum is an exact double
    wide = np.zeros((len(q), len(x)), object)
    for i, u in enumerate(q):
        for j, v in enumerate(x):
            wide[i, j] = sum(s * t for s, t in zip(u, v))
            if abs(wide[i, j]) >= 2**63:
                raise OverflowError("a score does not fit 64 bits")
    return wide.astype(np.int64)


def _best(scores: np.ndarray, ids: list, first: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one query in a block."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    out: list[tuple[int, int]] = []
    for j in at[np.lexsort((first[at], -scores[at]))][:k]:
        out += [(int(scores[j]), i) for i in ids[j]]
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def search(queries: DataFrame, rows: DataFrame, k: int, pivots: int | None = None, annuli: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score: the k best rows for each query; both sides are (id, v) of `quantised`. Without pivots or annuli, as many as `layout` says."""
    spark = rows.sparkSession
    more = k + 1
    order = Window.partitionBy("v").orderBy("id")
    folded = rows.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= more).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    folded = write_table(folded, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = folded.agg(F.max(F.size("v")), F.max(norm), F.count("*")).first()
    width, count = max(1, facts[0] or 0), facts[2]
    empty = "query_id long, rank int, id long, score long"
    if not count:
        return spark.createDataFrame([], empty)
    fit = layout(count, sample, block)
    pivots, annuli = pivots or fit[0], annuli or fit[1]
    picked = [r.v for r in folded.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample).collect()]  # bounded: the sample
    space = spark.sparkContext.broadcast(Space(picked, width, float(facts[1]), pivots))

    def assign(batch):
        d = space.value.data(_matrix(batch.column(0).to_pylist(), width))
        near = d.argmin(1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["v", "ids", "pivot", "dist"])

    index = write_table(map_batches(folded.select("v", "ids"), assign, "v array<long>, ids array<long>, pivot int, dist double"), "index")
    shares = [(n + 1) / annuli for n in range(annuli - 1)]
    cuts = {r.pivot: r.cuts or [] for r in index.groupBy("pivot").agg((F.percentile_approx("dist", shares) if shares else F.array()).alias("cuts")).collect()}  # a row a pivot
    at = F.create_map(*[x for p, c in cuts.items() for x in (F.lit(p), F.array(*map(F.lit, c)).cast("array<double>"))])[F.col("pivot")]
    celled = index.withColumn("cell", F.col("pivot") * annuli + F.size(F.filter(at, lambda c: c < F.col("dist"))))
    cells = celled.groupBy("cell", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).orderBy("cell").collect()  # a row an annulus
    salts = {r.cell: -(-r.n // block) for r in cells}
    number, pivot, low, high = (np.array([r[c] for r in cells]) for c in ("cell", "pivot", "low", "high"))
    salted = celled.withColumn("salt", F.pmod(F.xxhash64("v"), F.create_map(*[F.lit(x) for kv in salts.items() for x in kv])[F.col("cell")]).cast("int"))

    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.xxhash64("v").alias("q")).distinct()
    asked = write_table(asked, "asked")
    distinct = write_table(asked.select("q", "qv").distinct(), "queries")
    chunks = max(1, -(-distinct.count() // block))
    salted = salted.select("cell", "salt", "v", "ids")
    best = distinct.select("q", "qv", F.lit(None).cast("array<struct<s:long,i:long>>").alias("top"))
    start = 0
    for stop in (*ROUNDS, len(cells)):
        if start >= len(cells):
            break

        def visit(batch, start=start, stop=stop):
            vectors, tops = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            bound = space.value.bound(_matrix(vectors, width), pivot, low, high)
            kth = np.array([-t[more - 1]["s"] if t is not None and len(t) >= more else -np.inf for t in tops])
            turn = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
            row = np.repeat(np.arange(len(vectors)), turn.shape[1])
            cell = turn.ravel()
            on = bound[row, cell] >= kth[row]
            row, cell = row[on], cell[on]
            if not len(row):
                return
            # A row a block of the annulus.
            parts = np.array([salts[c] for c in number[cell].tolist()])
            row, cell = np.repeat(row, parts), np.repeat(cell, parts)
            salt = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            for a in range(0, len(row), 2000):
                r, part = row[a : a + 2000], slice(a, a + 2000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[cell[part]].astype(np.int32)), pa.array(salt[part].astype(np.int32)), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(np.where(np.isinf(kth[r]), -(2.0**62), kth[r]).astype(np.int64))],
                    ["cell", "salt", "q", "qv", "kth"],
                )

        visits = map_batches(best.select("q", "qv", "top"), visit, "cell int, salt int, q long, qv array<long>, kth long")
        visits = write_table(visits.withColumn("chunk", F.pmod("q", F.lit(chunks)).cast("int")), "visits")
        blocks = salted.join(visits.select("cell", "salt", F.col("chunk").alias("part")).distinct().hint("merge"), ["cell", "salt"])

        def meet(left, right):
            out: list = [[], [], []]
            if left.num_rows and right.num_rows:
                ids = right["ids"].to_pylist()
                first = np.array([i[0] for i in ids])
                scores = exact_scores(left["qv"].to_pylist(), right["v"].to_pylist(), width)
                for q, kth, own in zip(left["q"].to_pylist(), left["kth"].to_pylist(), scores):
                    for score, i in _best(own, ids, first, more):
                        if score >= kth:
                            out[0].append(q), out[1].append(score), out[2].append(i)
            return pa.table([pa.array(c, pa.int64()) for c in out], ["q", "score", "id"])

        met = visits.groupBy("cell", "salt", "chunk").cogroup(blocks.groupBy("cell", "salt", "part")).applyInArrow(meet, "q long, score long, id long")
        found = met.select("q", F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")).alias("t"))
        old = best.filter("top is not null").select("q", F.explode("top").alias("t"))
        merged = found.union(old).groupBy("q").agg(F.slice(F.array_sort(F.collect_set("t")), 1, more).alias("top"))
        before = best
        best = write_table(distinct.join(merged, "q", "left"), "best")
        drop_table(visits, *([before] if start else []))
        start = stop
    answers = asked.join(best.select("q", F.col("qv").alias("bv"), "top"), "q").filter(F.col("qv") == F.col("bv"))
    own = F.slice(F.filter("top", lambda t: t["i"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", F.posexplode(own).alias("at", "t"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.i").alias("id"), (-F.col("t.s")).alias("score"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows.filter("id % 50 = 0"), rows, 5).withColumnRenamed("id", "vec_id")


QUERIES = {"op4_pivot_topk": op4_pivot_topk}
ORACLES = {
    "op4_pivot_topk": """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""
}
