"""Best-fit packing of documents into sequences by linear grouping.

Texts become token ids with an end id behind them; only longer ones are cut, into full pieces behind a
shorter first one, so each cut text brings one piece that is not full. The plan is made on the count
of pieces by length, which the sequence length bounds whatever the corpus:

1. Lengths above a share of the capacity are sorted and dealt into groups of equal cardinality; each
   length is rounded up to its group's largest.
2. Over these few sizes, the configurations of a sequence are optimised by column generation
   (fractional, then rounded down).
3. Actual pieces take the places of their group, longest first; the last place of a sequence goes to the
   longest piece that its group or one of longer pieces has for the room actually left.
4. What is left, longest first, goes to the smallest gap that holds it, or opens a sequence.

The plan is a list of runs (so many pieces of one length, the sequence of the first, the place there).
Pieces are numbered within their length by salted groups, so that a length that a third of all pieces
share is no single task, and meet the plan in a broadcast join: the plan holds a few runs for each
length, and its size is checked.

Defined results: null and empty texts are one end id; no documents give no rows; equal rows are
packed each; rows are told apart by key, piece and ids only. Other columns are never read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, write_table
from tidemark.llm.tokens import Encoder

CAPACITY = 2048
END_ID = 0
#: Tried (share of the capacity above which a length is grouped, groups); the plan of fewest sequences is kept.
SCHEMES = ((0.45, 64), (0.4, 48), (0.25, 32))
#: Pieces of one length that are numbered in one task, about.
NUMBERED = 50_000
#: Runs of a plan that are broadcast; a larger plan is shuffled.
MOST_RUNS = 500_000


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Optimal fractional use of configurations (counts by size) that covers the demand, by column generation."""
    k, s = len(sizes), np.array(sizes)
    basis = np.diag(capacity // s).astype(float)
    want = np.array(demand, float)
    x = np.linalg.solve(basis, want)
    for _ in range(20 * k + 50):
        value = np.linalg.solve(basis.T, np.ones(k))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(s.min()), capacity + 1):
            fits = np.where(s <= room, best[room - np.minimum(s, room)] + value, -1.0)
            g = int(fits.argmax())
            if fits[g] > best[room - 1] + 1e-12:
                best[room], took[room] = fits[g], g
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
                continue
            column[took[room]] += 1
            room -= sizes[took[room]]
        u = np.linalg.solve(basis, column)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        x = np.maximum(np.linalg.solve(basis, want), 0)
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


def plan(counts: dict[int, int], capacity: int, share: float, groups: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Classes of sequences: ((length, pieces of it), ...) and how many sequences are so filled."""
    counts = {n: c for n, c in counts.items() if c}
    made: list[tuple[tuple, int]] = []
    gaps: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    big = sorted((n for n in counts if n > share * capacity and n < capacity), reverse=True)
    queues: list[list[list[int]]] = []
    each, left = -(-sum(counts[n] for n in big) // groups), 0
    for n in big:
        c = counts[n]
        while c:
            if not left:
                queues.append([])
                left = each
            part = min(c, left)
            queues[-1].append([n, part])
            c, left = c - part, left - part
    held = [dict(q) for q in queues]  # a group's pieces by length, longest first
    sizes = [q[0][0] for q in queues]
    for pattern, times in configurations(sizes, [sum(g.values()) for g in held], capacity) if queues else ():
        bins, used = int(times + 1e-9), [g for g, a in enumerate(pattern.tolist()) for _ in range(a)]
        while bins and used:
            # So many sequences alike: their groups' longest pieces, then, for the last place, the longest piece of any
            # group that the actual lengths leave room for.
            took: list[tuple[int, int]] = []
            room = capacity
            for k, g in enumerate(used):
                among = range(g + 1) if 0 < k == len(used) - 1 else (g,)
                fits = [(n, h) for h in among for n, c in held[h].items() if n <= room and c > took.count((h, n))]
                if not fits:
                    break
                n, h = max(fits)
                took.append((h, n))
                room -= n
            if len(took) < len(used):
                break
            step = min(bins, *(held[g][n] // took.count((g, n)) for g, n in set(took)))
            filled: dict[int, int] = defaultdict(int)
            for g, n in took:
                filled[n] += 1
                held[g][n] -= step
                if not held[g][n]:
                    del held[g][n]
            gaps[room].append((tuple(filled.items()), step))
            bins -= step
    rest: dict[int, int] = defaultdict(int)
    for group in held:
        for n, c in group.items():
            rest[n] += c
    grouped = set(big)
    for n, c in counts.items():
        if n not in grouped:
            rest[n] += c
    open_gaps = sorted(g for g in gaps if gaps[g])
    for n in sorted(rest, reverse=True):
        c = rest[n]
        while c:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):
                if capacity not in gaps or not gaps[capacity]:
                    bisect.insort(open_gaps, capacity)
                gaps[capacity].append(((), -(-c // (capacity // n))))
                at = bisect.bisect_left(open_gaps, n)
            gap = open_gaps[at]
            held, bins = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
            each = min(gap // n, c)
            full = min(bins, c // each)
            for left, many, m in ((gap - each * n, ((n, each),), full), (gap, (), bins - full)):
                if m:
                    if left not in gaps or not gaps[left]:
                        bisect.insort(open_gaps, left)
                    gaps[left].append((held + many, m))
            c -= full * each
    for classes in gaps.values():
        made += [x for x in classes if x[0]]
    return made


def best_plan(counts: dict[int, int], capacity: int, schemes: Iterable = SCHEMES):
    return min((plan(counts, capacity, *scheme) for scheme in schemes), key=lambda made: sum(m for _, m in made))


def runs(classes, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset there); ranks count each length's pieces from 0."""
    out, seen, sequence = [], defaultdict(int), 0
    for filled, many in classes:
        offset = 0
        for n, each in filled:
            out.append((n, seen[n], seen[n] + each * many, each, sequence, offset))
            seen[n] += each * many
            offset += n * each
        assert offset <= capacity
        sequence += many
    return out


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    end = int(end_id).to_bytes(4, "little")

    def cut(batch, encoder):
        rows: list = [[] for _ in range(6)]
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = encoder.encode(body, body.encode()) + end
            n = len(ids) // 4
            first = n % capacity or capacity
            at, size, number = 0, min(n, first), 0
            while at < n:
                part = ids[at * 4 : (at + size) * 4]
                for column, value in zip(rows, (name, number, at, size, zlib.crc32(part), part if keep_ids else None)):
                    column.append(value)
                at, size, number = at + size, capacity, number + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["key", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")))
    return map_batches(rows, cut, "key long, piece int, start long, length long, ids_crc32 long, ids binary", lambda: Encoder(path))


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian bytes where keep_ids)."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    cut = write_table(pieces(docs, key, text, path, capacity, end_id, keep_ids), "pieces")
    counts = dict(cut.groupBy("length").count().collect())  # a row for each length at most
    taken = runs(best_plan(counts, capacity), capacity)
    by_run = spark.createDataFrame(taken or [(0, 0, 0, 1, 0, 0)], "length long, r0 long, r1 long, each long, s0 long, o0 long")
    by_run = F.broadcast(by_run) if len(taken) <= MOST_RUNS else by_run
    salts = max(8, -(-max(counts.values(), default=0) // NUMBERED))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(salts)))
    group = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    group = group.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("key", "piece", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(inside)).join(group, ["length", "salt"]).withColumn("rank", F.col("rn") - 1 + F.col("before"))
    placed = ranked.join(by_run, "length").filter("rank >= r0 and rank < r1")
    return placed.select(
        F.col("key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("s0 + (rank - r0) div each").alias("sequence_id"),
        F.expr("o0 + (rank - r0) % each * length").alias("offset"),
        "ids",
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
