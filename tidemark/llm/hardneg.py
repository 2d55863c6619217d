"""Hard negatives: for an anchor and each of its nearest rows of the same label, near rows of other labels.

Vectors are turned by an orthogonal PCA basis (of the second moments of a bounded sample), so that leading
components carry most of an inner product. Anchors in chunks meet all rows in blocks; partial products of the
leading components are summed up, the rest is bounded by the norms of what is left (Cauchy-Schwarz) and a slack
for rounding, and a pair whose bound cannot reach what its anchor still wants is discarded; the next components
are multiplied for the others only. Pairs that survive all components are scored again with integer products.

The positives are searched first, then the negatives in the bands that the positives' scores open. A task
holds one chunk of anchors and reads its share of the blocks one by one; it keeps what an anchor wants and no
more, so what leaves a task does not depend on the rows it read. The anchors (a stated query set) are held
against all rows; nothing is sampled but the basis, on which no result depends.

Defined results: rows whose key, label or vector is null, or whose vector holds a null or non-finite component,
take no part; vectors of different lengths meet as if zeros followed the shorter; rows that repeat count once,
and a row never meets its own key. Ties go to the smaller key. An anchor without other rows of its label has no
rows, nor has a positive without a negative in its band. Scores that could leave 64 bits raise an error. Other
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, map_batches, table, write_table
from tidemark.llm.vectors import extent, integers, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is at least LOW and at most HIGH per cent of the positive's.
LOW, HIGH = 30, 90
SAMPLE, BLOCK, CHUNK = 4096, 512, 1024
#: Rows that one task holds an anchor chunk against, at most.
MOST_ROWS = 1 << 20
PAIRS = 1 << 16
FAR = 2**62


def basis_of(sample: np.ndarray) -> np.ndarray:
    """Columns: orthonormal directions, those of most energy first."""
    x = sample.astype(np.float64)
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])


def stages(width: int) -> list[tuple[int, int]]:
    ends = sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2), width})
    return list(zip([0, *ends], ends))


class Turned:
    """Integer vectors, their turned forms, and the norms that are left after each stage."""

    def __init__(self, v: np.ndarray, basis: np.ndarray):
        self.v, self.x = v, v.astype(np.float64) @ basis
        left = np.cumsum((self.x * self.x)[:, ::-1], 1)[:, ::-1]
        self.norm = np.sqrt(left[:, 0])
        self.left = [np.sqrt(left[:, stop]) if stop < left.shape[1] else np.zeros(len(v)) for _, stop in stages(v.shape[1])]


class Wanted:
    """What a chunk of anchors wants: per group (an anchor and a band of scores) the k best (score, key) so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, turned: Turned, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.turned, self.k, self.same = ids, labels, turned, k, same
        self.owner, self.low, self.high, self.least = owner, low, high, low.copy()  # owners ascend
        self.first, self.count = np.searchsorted(owner, np.arange(len(ids))), np.bincount(owner, minlength=len(ids))
        self.kept = [np.zeros(0, np.int64)] * 3  # group, score, key
        self.seen = self.scored = 0
        self.top = np.full(len(ids), -FAR)
        np.maximum.at(self.top, owner, high)

    def survivors(self, labels: np.ndarray, keys: np.ndarray, rows: Turned) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) that may be wanted."""
        floor = np.full(len(self.ids), FAR)
        np.minimum.at(floor, self.owner, self.least)
        a = np.flatnonzero((self.count > 0) & (np.isin(self.labels, labels) if self.same else True))
        r = np.arange(len(keys))
        fit = (self.labels[a][:, None] == labels) == self.same
        fit &= self.ids[a][:, None] != keys
        self.seen += int(fit.sum())
        part = np.zeros(fit.shape)
        mine = self.turned
        for (start, stop), own, other in zip(stages(mine.x.shape[1]), mine.left, rows.left):
            part += mine.x[a, start:stop] @ rows.x[r, start:stop].T
            rest = np.outer(own[a], other[r]) + 1e-9 * np.outer(mine.norm[a], rows.norm[r]) + 1e-6
            fit &= (part + rest >= floor[a][:, None]) & (part - rest <= self.top[a][:, None])
            on, up = fit.any(1), fit.any(0)
            if not on.any():
                break
            if on.sum() * up.sum() < 0.9 * fit.size:
                a, r, part, fit = a[on], r[up], part[np.ix_(on, up)], fit[np.ix_(on, up)]
        i, j = np.nonzero(fit)
        return a[i], r[j]

    def meet(self, keys: np.ndarray, labels: np.ndarray, rows: Turned) -> None:
        a, r = self.survivors(labels, keys, rows)
        self.scored += len(a)
        for s in range(0, len(a), PAIRS):
            b, c = a[s : s + PAIRS], r[s : s + PAIRS]
            scores = np.einsum("ij,ij->i", self.turned.v[b], rows.v[c])  # int64, exact
            times = self.count[b]
            at = np.repeat(np.arange(len(b)), times)
            group = np.repeat(self.first[b], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            score = scores[at]
            fits = (score >= self.least[group]) & (score <= self.high[group])
            self.keep(group[fits], score[fits], keys[c][at][fits])

    def keep(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(group):
            return
        group, score, key = (np.concatenate(x) for x in zip(self.kept, (group, score, key)))
        order = np.lexsort((key, -score, group))
        group, score, key = group[order], score[order], key[order]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        rank = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
        best = rank < self.k
        self.kept = [group[best], score[best], key[best]]
        last = rank == self.k - 1
        self.least[group[last]] = score[last]


def _pack(block: int, width: int, kind: str):
    """Rows (id, label, v) in blocks of neighbouring labels: keys, labels and vectors as bytes."""

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 16 * block:
                yield from cut(held)
                held = []
        if held:
            yield from cut(held)

    def cut(held):
        rows = pa.Table.from_batches(held)
        keys, labels = (rows.column(n).to_numpy() for n in range(2))
        v = matrix(rows.column(2), width).astype(kind)
        order = np.lexsort((keys, labels))
        parts = [order[s : s + block] for s in range(0, len(order), block)]
        columns = [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (keys, labels, v)]
        yield pa.RecordBatch.from_arrays(columns, ["k", "l", "v"])

    return run


def _search(rows: DataFrame, anchors: DataFrame, chunks: int, groups: int, width: int, kind: str, basis, k: int, same: bool) -> DataFrame:
    """Anchors (c, k, l, v, owner, low, high as bytes) against blocks of rows: a (place of the anchor's group in its chunk), c, score, id."""
    none = F.lit(None).cast("binary")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("c", spread(groups).alias("g"), F.lit(0).alias("kind"), "k", "l", "v", "owner", "low", "high")
    right = rows.select(spread(chunks).alias("c"), F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("kind"), "k", "l", "v", none.alias("owner"), none.alias("low"), none.alias("high"))
    grid = left.union(right).repartitionById(min(chunks * groups, 20000), F.col("c") * groups + F.col("g")).sortWithinPartitions("c", "g", "kind")

    def told(c, wanted):
        group, score, key = wanted.kept
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(group), c, np.int32)), pa.array(group), pa.array(score), pa.array(key)], ["c", "a", "score", "id"])

    def run(batches):
        at = wanted = None
        for batch in batches:
            for n in range(batch.num_rows):
                c, g, first = (batch.column(i)[n].as_py() for i in range(3))
                keys, labels, v = (np.frombuffer(batch.column(3 + i)[n].as_buffer(), t) for i, t in enumerate((np.int64, np.int64, kind)))
                turned = Turned(v.reshape(len(keys), width).astype(np.int64), basis.value)
                if (c, g) != at:
                    if wanted is not None:
                        yield told(at[0], wanted)
                    at, wanted = (c, g), None
                if first == 0:
                    owner, low, high = (np.frombuffer(batch.column(6 + i)[n].as_buffer(), np.int64).copy() for i in range(3))
                    wanted = Wanted(keys, labels, turned, owner, low, high, k, same)
                elif wanted is not None:
                    wanted.meet(keys, labels, turned)
        if wanted is not None:
            yield told(at[0], wanted)

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    return grid.mapInArrow(run, "c int, a long, score long, id long")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both sides are (id, label, v), two longs and an array of longs."""
    spark = rows.sparkSession
    rows = write_table(rows.select("id", "label", "v").distinct(), "vectors")
    count, width, most = extent(rows)
    width = max(1, width)
    if 100 * width * most * most >= 2**62:
        raise OverflowError("a score does not fit 64 bits")
    kind = next(t for t in ("int16", "int32", "int64") if most < np.iinfo(t).max)
    sample = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()  # bounded: the sample
    basis = spark.sparkContext.broadcast(basis_of(matrix(sample.column(0), width)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 256)
    blocks = write_table(rows.mapInArrow(_pack(block, width, kind), "k binary, l binary, v binary"), "blocks")

    asked = write_table(anchors.select("id", "label", "v").distinct().withColumn("a", F.monotonically_increasing_id()), "anchors")
    chunks = max(1, -(-asked.count() // chunk))
    groups = max(1, -(-(tasks or 4 * spark.sparkContext.defaultParallelism) // chunks), -(-count // MOST_ROWS))
    numbered = asked.withColumn("c", F.pmod(F.xxhash64("a"), F.lit(chunks)).cast("int"))

    def pack(kinds):
        def run(t):
            keys, labels = t["id"].to_numpy(), t["label"].to_numpy()
            order = np.argsort(t["a"].to_numpy(), kind="stable")
            v = matrix(t["v"], width).astype(kind)
            bands = [t["bands"][int(n)].as_py() for n in order] if kinds else [[(-FAR, FAR)]] * len(order)
            bands = [[(b["low"], b["high"]) if kinds else b for b in own] for own in bands]
            owner = np.repeat(np.arange(len(order)), [len(b) for b in bands])
            ends = np.array([x for b in bands for x in b], np.int64).reshape(-1, 2)
            data = [keys[order], labels[order], v[order], owner.astype(np.int64), ends[:, 0], ends[:, 1]]
            return pa.table([t["c"][:1].cast(pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data]], ["c", "k", "l", "v", "owner", "low", "high"])

        return run

    packed = "c int, k binary, l binary, v binary, owner binary, low binary, high binary"
    place = F.row_number().over(Window.partitionBy("c").orderBy("a", "p")) - 1  # a chunk's groups, as they are packed
    best = lambda n: F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))), 1, n)

    first = numbered.groupBy("c").applyInArrow(pack(False), packed)
    found = _search(blocks, first, chunks, groups, width, kind, basis, positives, True).groupBy("c", F.col("a").alias("place")).agg(best(positives).alias("t"))
    named = numbered.select("c", "a", "id", F.lit(0).alias("p")).withColumn("place", place.cast("long"))
    found = found.join(named, ["c", "place"]).select("c", "a", F.col("id").alias("anchor_id"), F.posexplode("t").alias("p", "t"))
    bands = found.select("c", "a", "anchor_id", "p", F.col("t.i").alias("positive_id"), (-F.col("t.s")).alias("positive_score"))
    down = lambda x: f"({x} - pmod({x}, 100L)) div 100L"  # noqa: E731 - a floored quotient of longs
    bands = bands.withColumns({"low": -F.expr(down(f"({-low}L * positive_score)")), "high": F.expr(down(f"({high}L * positive_score)"))})
    bands = write_table(bands.filter("low <= high").withColumn("place", place.cast("long")), "positives")

    wanted = bands.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "low", "high"))), lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("bands"))
    second = numbered.join(wanted, "a").groupBy("c").applyInArrow(pack(True), packed)
    met = _search(blocks, second, chunks, groups, width, kind, basis, negatives, False).groupBy("c", F.col("a").alias("place")).agg(best(negatives).alias("t"))
    met = write_table(met.join(bands, ["c", "place"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("t").alias("n", "t")), "negatives")
    drop_table(rows, blocks, asked, bands)
    return met.select("anchor_id", "positive_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("t.i").alias("negative_id"), "positive_score", (-F.col("t.s")).alias("negative_score"))


def labelled(rows: DataFrame, label, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, label, v of rows that can take part."""
    return integers(rows, vector, SCALE, id=F.col(key).cast("long"), label=label.cast("long")).filter("id is not null and label is not null")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled(table(spark, sf_dir, "embeddings"), label)
    return mine(rows, rows.filter("id % 100 = 0"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": f"""
    WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.v, r.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
        FROM v a, v r WHERE a.id % 100 = 0 AND r.id <> a.id),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same),
    m AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score WHERE p.n <= {POSITIVES})
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= {NEGATIVES}"""
}
