"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is a weighted set of word shingles (weight: how often it occurs). Each shingle is a Poisson
process with that rate whose points fall on the slots of a signature; a slot keeps the shingle of its
first point. Points are drawn round by round for all shingles of a batch, and a shingle stops once its
next point comes after every slot of its document is taken earlier. The share of equal slots estimates
the probability Jaccard similarity J_P(a, b) = sum over d of 1 / sum over e of max(a_e / a_d, b_e / b_d).

Copies are folded first, so a group of copies costs one row. Texts that share a band of slots are
candidates: each is held against the least id of its bucket and against its hub, the member that meets
most others over all its buckets (in a family of edited copies, the copy the others stem from), which
is linear in the bucket; verified pairs (exact J_P of the texts) are links, and links make classes
(connected components). Buckets that still hold several classes are then searched across classes in
blocks of bounded size, so no link is given up for the size of a bucket: J_P is at most the sum of the
smaller shares, sum over d of min(a_d / |a|, b_d / |b|), so only pairs that reach the threshold there are
computed; a pair inside one class is never looked at, and only links that join two classes leave a block.
Joins on a band, a copy or an end that very many rows share are dealt to several tasks.

Defined results: words are runs without ASCII white space, in lower case; a text of fewer words than a
shingle is one shingle; a text without words equals only its copies; a null text is empty; rows of one
key are one document; a row with a null key has no class (null) and duplicates nothing. The class id
is the least key of the class. Other columns are never read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, by_bytes, components, drop_table, hot_keys, map_batches, runs_of, salted_join, sized_join, table, whole_groups, write_table
from tidemark.llm.phrases import mix
from tidemark.llm.words import prefix, spans, stretch_hash

SHINGLE = 5
SIMILARITY = 0.8
SLOTS, BANDS = 64, 16
#: Members of a block across classes: those outside the bucket's main class, all.
BLOCK = (128, 256)
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of the (lower-case) texts, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = spans(data)
    words = stretch_hash(prefix(data), start, end)
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, base)
    number = np.diff(first)
    # Words of a row of shingles: the next `width`, or for a short text all it has (the rest stays 0).
    many = np.where(number >= width, number - width + 1, np.minimum(number, 1))
    owner = np.repeat(np.arange(len(texts)), many)
    at = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    padded = np.append(words, np.zeros(width, np.uint64))
    out = np.zeros(len(owner), np.uint64)
    for k in range(width):
        inside = at + k < first[1:][owner]
        out = out * _U(0xD6E8FEB86659FD93) + np.where(inside, padded[np.minimum(at + k, len(padded) - 1)], _U(0))
    return owner, mix(out)


def signatures(texts: list[bytes], slots: int = SLOTS, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts, slots) of 32-bit marks of the winning shingles, and which texts have any shingle. At most 512 texts."""
    assert len(texts) <= 512
    owner, h = shingles(texts, width)
    packed = np.sort((owner.astype(np.uint64) << _U(55)) | (h >> _U(9)))
    lead = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, int)
    weight = np.diff(np.append(lead, len(packed))).astype(float)
    item = packed[lead] & _U((1 << 55) - 1)
    doc = (packed[lead] >> _U(55)).astype(np.int64)
    n = len(texts)
    first = np.full(n * slots, np.inf)
    mark = np.zeros(n * slots, np.uint32)
    name = (mix(item.copy()) >> _U(32)).astype(np.uint32)
    time = np.zeros(len(item))
    state = item * _U(0xA0761D6478BD642F)
    while len(item):
        state += _STEP
        draw = mix(state.copy())
        time -= np.log(((draw >> _U(12)).astype(float) + 0.5) * 2.0**-52) / weight
        at = doc * slots + (draw & _U(slots - 1)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        mark[at[won]] = name[won]
        on = time <= first.reshape(n, slots).max(1)[doc]
        if not on.all():
            item, doc, weight, name, time, state = (x[on] for x in (item, doc, weight, name, time, state))
    has = np.zeros(n, bool)
    has[owner] = True
    return mark.reshape(n, slots), has


def weighted(text: str, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    _, h = shingles([text.lower().encode()], width)
    return np.unique(h, return_counts=True)


def similarity(a: tuple, b: tuple) -> float:
    """Exact probability Jaccard of two weighted sets (sorted hashes, counts); 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    below = only_a + np.cumsum(x)  # elements whose ratio b / a is no larger count by a
    above = only_b + y.sum() - np.cumsum(y)
    return float((1 / (below / x + above / y)).sum())


def _sign(rows: DataFrame, width: int) -> DataFrame:
    """id, copy (hash of the text) and bands; no bands for a text without words."""

    def run(batch):
        texts = [t.lower().encode() for t in batch.column(2).to_pylist()]
        marks, has = (np.concatenate(x) for x in zip(*(signatures(texts[part], SLOTS, width) for part in by_bytes(list(map(len, texts))))))
        each = SLOTS // BANDS
        bands = np.zeros((len(texts), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(each):
            bands = bands * _U(0xD6E8FEB86659FD93) + marks[:, k::each].astype(np.uint64)
        bands = mix(bands).view(np.int64)
        keep = has.tolist()
        dealt = [b if k else [] for b, k in zip(bands.tolist(), keep)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dealt, pa.list_(pa.int64()))], ["id", "copy", "bands"])

    return map_batches(rows.select("id", "copy", "body"), run, "id long, copy string, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""

    def run(batch):
        known = lru_cache(maxsize=16)(lambda t: weighted(t, width))
        ok = [similarity(known(x), weighted(y, width)) >= threshold - 1e-12 for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return batch.select([2, 3]).filter(pa.array(ok))

    total = pairs.count()
    hot = lambda end: hot_keys(pairs.groupBy(end).agg(F.count("*").alias("n")), end, total)
    # One plan at every size: a broadcast of few texts would hide what the join moves once there are many.
    joined = salted_join(pairs, texts.select(F.col("id").alias("b"), F.col("body").alias("right")), "b", hot("b"), hint="merge", by=("a", "b"))
    joined = salted_join(joined, texts.select(F.col("id").alias("a"), F.col("body").alias("left")), "a", hot("a"), hint="merge", by=("a", "b"))
    return map_batches(joined.select("left", "right", "a", "b"), run, "a long, b long")


class Shares:
    """An inverted index of some texts' shingles: each text's share of each of its shingles."""

    def __init__(self, bags: list):
        h = np.concatenate([h for h, _ in bags])
        share = np.concatenate([w / max(1, w.sum()) for _, w in bags])
        text = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
        order = np.argsort(h, kind="stable")
        self.h, self.share, self.text, self.n = h[order], share[order], text[order], len(bags)

    def bounds(self, bag: tuple) -> np.ndarray:
        """For each text, the sum of the smaller shares: at least its similarity to the bag."""
        h, w = bag
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.text[at], np.minimum(self.share[at], np.repeat(w / max(1, w.sum()), many)), self.n)


def block_links(band: int, left: list, right: list, threshold: float, width: int) -> list[tuple[int, int]]:
    """Links that join classes, between members (id, root, bands, text, in main class) of one bucket."""
    roots = {r: n for n, r in enumerate({row[1] for row in (*left, *right)})}
    label = np.arange(len(roots))
    out = []
    for part in by_bytes([len(r[3]) for r in right]):
        some = right[part]
        root = np.array([roots[r[1]] for r in some])
        ids, main, bands = np.array([r[0] for r in some]), np.array([r[4] for r in some]), np.array([r[2] for r in some])
        bags = [weighted(r[3], width) for r in some]
        index = Shares(bags)
        for row in left:
            # A pair of the outer members is looked at once, and in the first bucket that both share.
            own = np.array(row[2])
            same = bands == own
            on = (main | (ids > row[0])) & (label[root] != label[roots[row[1]]]) & (own[same.argmax(1)] == band)
            if not on.any():
                continue
            bag = weighted(row[3], width)
            most = index.bounds(bag)
            on &= most >= threshold - 1e-9
            for j in sorted(np.flatnonzero(on).tolist(), key=lambda j: -most[j]):
                a, b = label[roots[row[1]]], label[root[j]]
                if a != b and similarity(bag, bags[j]) >= threshold - 1e-12:
                    label[label == b] = a
                    out.append((row[0], some[j][0]))
    return out


def _across(mixed: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (a, b) between classes of one bucket; mixed: (band, id, n, root) of the buckets that hold several, n members each."""
    spark = mixed.sparkSession
    sizes = mixed.groupBy("band", "root").count().groupBy("band").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("n"))
    sizes = sizes.select("band", "n", F.col("m.root").alias("main"), F.ceil((F.col("n") - F.col("m.count")) / BLOCK[0]).cast("int").alias("nu"), F.ceil(F.col("n") / BLOCK[1]).cast("int").alias("nv"))
    rows = sized_join(mixed, sizes, "band", "n", mixed.count()).join(texts, "id").withColumn("in_main", F.col("root") == F.col("main"))
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["band", "u", "v", "side", "id", "root", "bands", "body", "in_main"]
    left = rows.filter("not in_main").withColumn("u", number("nu")).withColumn("v", every("nv")).withColumn("side", F.lit(0)).select(*columns)
    right = rows.withColumn("v", number("nv")).withColumn("u", every("nu")).withColumn("side", F.lit(1)).select(*columns)
    keys = ("band", "u", "v")

    def run(batches):
        for t in whole_groups(batches, (0, 1, 2)):
            band = t["band"].to_numpy()
            side = t["side"].to_numpy()
            members = list(zip(*(t[c].to_pylist() for c in ("id", "root", "bands", "body", "in_main"))))
            start, size = runs_of([t[c].to_numpy() for c in keys])
            found = []
            for a, n in zip(start.tolist(), size.tolist()):
                cut = a + int(np.count_nonzero(side[a : a + n] == 0))
                if a < cut < a + n:
                    found += block_links(int(band[a]), members[a:cut], members[cut : a + n], threshold, width)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    dealt = left.unionByName(right).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "side", "id")
    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """One row per row of docs: key, class_id (the least key of its class), duplicate (not that key)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("copy", F.sha2("body", 256))
    signed = write_table(_sign(rows.filter("id is not null"), width), "signed")
    reps = write_table(signed.groupBy("copy").agg(F.min(F.struct("id", "bands")).alias("r"), F.count("*").alias("n")).select("copy", "r.*", "n"), "reps")
    dealt = reps.select("id", F.explode("bands").alias("band"))
    # Members of buckets of several: with the bucket's size, then with its least id and its hub.
    buckets = dealt.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    sized = write_table(salted_join(dealt, buckets, "band", hot_keys(buckets, "band", reps.count() * BANDS)), "member")
    met = sized.groupBy("id").agg(F.sum("n").alias("met"))
    ends = sized.join(met, "id").groupBy("band").agg(F.min("id").alias("low"), F.max(F.struct("met", (-F.col("id")).alias("i"))).alias("hub"), F.first("n").alias("n"))
    total = sized.count()
    both = ends.select("band", "n", F.array_distinct(F.array("low", -F.col("hub.i"))).alias("ends"))
    member = write_table(sized_join(sized, both, "band", "n", total), "member")
    pairs = member.select("id", F.explode("ends").alias("end")).filter("id <> end").select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()
    pairs = write_table(pairs, "pairs")
    texts = rows.join(member.select("id").distinct().hint("merge"), "id").select("id", "copy", "body").dropDuplicates(["id", "copy"])
    texts = write_table(texts, "texts")
    links = write_table(_verify(pairs, texts, threshold, width), "links")
    roots = write_table(components(links), "roots")
    # Across classes: what the ends of a bucket did not tie together.
    rooted = member.select("band", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "n", F.coalesce("root", "id").alias("root"))
    several = rooted.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.first("n").alias("n")).filter("r0 < r1")
    mixed = write_table(sized_join(rooted, several.select("band", "n"), "band", "n", total), "mixed")
    more = write_table(_across(mixed, texts.join(reps.select("copy", "bands"), "copy").select("id", "body", "bands"), threshold, width), "links")
    drop_table(sized, member, pairs, texts, links, mixed)
    ends = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    over = write_table(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "over")
    merged = roots.select("node", F.col("root").alias("old")).join(over.select(F.col("node").alias("old"), "root"), "old", "left").select("node", F.coalesce("root", "old").alias("root"))
    lone = over.join(roots.select("node"), "node", "left_anti").select("node", "root")
    found = write_table(merged.unionByName(lone), "roots")
    # A document's class: that of its text's representative; rows of one key share one even if their texts differ.
    named = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select("copy", F.coalesce("root", "id").alias("root"))
    own = salted_join(signed.select("id", "copy"), named, "copy", hot_keys(reps, "copy", signed.count())).groupBy("id").agg(F.min("root").alias("root"))
    own = write_table(own, "classes")
    drop_table(signed, reps, roots, more, over, found)
    out = rows.select("id").join(own.withColumnRenamed("id", "a"), F.col("id") == F.col("a"), "left")
    return out.select(F.col("id").alias(key), F.col("root").alias("class_id"), (F.col("id").isNotNull() & (F.col("root") < F.col("id"))).alias("duplicate"))


def op2_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op2_probminhash_dedup": op2_probminhash_dedup}
ORACLES: dict[str, str] = {}
