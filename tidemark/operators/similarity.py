"""Deduplication of postings by three signals, and market match by vectors."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.operators.joins import hot_keys, salted_join, sized_join, with_group
from tidemark.tables import drop_table, write_table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest_labels(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Mean cosine of each vector to its label's centroid: a join on the label, not on pairs."""
    parts = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return vectors.join(F.broadcast(centre), label).select(key, label, F.round(cosine(F.col(vector), F.col("centre")), 6).alias("similarity"))  # a row a label


def match_histogram(similarities: DataFrame, column: str) -> DataFrame:
    """Shares above 0.75, from 0.55, and up to it, and the mean as a percentage between 0 and 100."""
    s = F.col(column)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    percent = F.round(F.least(F.greatest(F.avg(s) * 100, F.lit(0.0)), F.lit(100.0)), 2)
    return similarities.agg(share(s > 0.75).alias("strong"), share((s > 0.55) & (s <= 0.75)).alias("moderate"), share(s <= 0.55).alias("weak"), percent.alias("match_pct"))


def exact_groups(df: DataFrame, key: str, hashed: Column) -> DataFrame:
    """Every row with the least key of its hash; the rows of a hot hash are spread over tasks."""
    rows = df.select(F.col(key).alias("key"), hashed.alias("h"))
    return with_group(rows, "h", df.count(), first=F.min("key")).select(F.col("key").alias(key), "first")


#: Words of a shingle; one of so many texts tells which shingles are common, from SEEN of these on; most of them that are told; bytes of text that are hashed at once; bits of a set's outline.
WIDTH, EVERY, SEEN, COMMON, STRETCH, OUTLINE = 5, 8, 2, 1 << 18, 1 << 16, 2048
_U = np.uint64
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))  # as bytes.split
_ODD = _U(0x9E3779B97F4A7C15)
_LETTER, _PLACE = (np.random.default_rng(seed).integers(0, 1 << 63, size, np.uint64) * _U(2) + _U(1) for seed, size in ((1, 256), (2, WIDTH)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and those of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, n, np.uint64)))) for n in (int(_ODD), pow(int(_ODD), -1, 1 << 64)))


_POWERS = _powers(STRETCH)


def _stretches(data: np.ndarray, ends: np.ndarray):
    """Cuts (from, to) of the bytes of several texts, of STRETCH at most where no word is longer; no word is cut. ends: where texts end, ascending."""
    at, size, most = 0, len(data), STRETCH
    while at < size:
        to = min(at + most, size)
        if to < size:
            space = np.flatnonzero(_SPACE[data[at:to]])[-1:]
            text = ends[max(0, np.searchsorted(ends, to, "right") - 1)]
            to = max(at + int(space[0]) + 1 if len(space) else at, int(text) if text <= to else at)
            if to == at:
                most *= 2
                continue
        yield at, to
        at, most = to, STRETCH


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts whose bytes follow each other, and how many words lie before each text's end."""
    hashes, starts = [], []
    for at, to in _stretches(data, ends):
        part = data[at:to]
        up, down = _POWERS if len(part) <= STRETCH else _powers(len(part))
        space = _SPACE[part]
        cut = np.zeros(len(part) + 1, bool)  # a word may begin here, as one ends here
        cut[0] = cut[-1] = True
        cut[1:] |= np.append(space[1:], True)
        cut[1:-1] |= space[:-1]
        cut[ends[np.searchsorted(ends, at) : np.searchsorted(ends, to, "right")] - at] = True
        first, last = np.flatnonzero(cut[:-1] & ~space), np.flatnonzero(cut[1:] & ~space) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER[part] * up[: len(part)], out=sums[1:])
        hashes.append(_mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _ODD))
        starts.append(first + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def _shingled(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and where each text's end; a text of fewer than WIDTH words is one shingle, one without words has none."""
    words, until = _word_hashes(data, ends)
    count = np.diff(until, prepend=0)
    sizes = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    stop = np.cumsum(sizes)
    out = np.zeros(stop[-1], np.uint64)
    for width in range(1, WIDTH):
        short = np.flatnonzero(count == width)
        begin = until[short] - width
        out[stop[short] - 1] = _mix(sum((words[begin + n] * _PLACE[n] for n in range(width)), np.full(len(short), width, np.uint64)))
    if len(words) >= WIDTH:
        h = np.full(len(words) - WIDTH + 1, WIDTH, np.uint64)
        for n in range(WIDTH):
            h += words[n : len(h) + n] * _PLACE[n]
        out[np.repeat(count >= WIDTH, sizes)] = _mix(h[np.arange(WIDTH, len(words) + 1) <= np.repeat(until, count)[: len(h)]])
    for a, b in zip((stop - sizes).tolist(), stop.tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[(stop - sizes)[sizes > 0]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[stop]


def shingles(df: DataFrame, key: str, text: str, common: np.ndarray | None = None, least: Fraction | None = None, outlined: bool = False) -> DataFrame:
    """Each text's key, number of distinct hashed word shingles m, and these (s) in one order for all texts: by hash, those of `common` behind the others.

    common: hashes from the rarest on. With `least` only the first m - ceil(least * m) + 1 are returned. Texts without words are left out.
    With `outlined` also OUTLINE bits (outline): one is set if a shingle's hash has its number as remainder.
    All words of a batch are hashed at once, in stretches; only sorting goes text by text.
    """
    spark = df.sparkSession
    common = np.zeros(0, np.uint64) if common is None else common
    order = np.argsort(common)
    told = spark.sparkContext.broadcast((common[order], order))
    num, den = (least.numerator, least.denominator) if least is not None else (0, 1)
    names = ["key", "m", "s", "outline"][: 4 if outlined else 3]

    def run(batches):
        known, place = told.value
        seen = np.zeros(1 << 22, bool)
        seen[known >> _U(42)] = True

        def rank(h: np.ndarray) -> np.ndarray:
            """The places of common shingles among these, -1 for others."""
            out = np.full(len(h), -1)
            maybe = np.flatnonzero(seen[h >> _U(42)])
            to = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            on = known[to] == h[maybe]
            out[maybe[on]] = place[to[on]]
            return out

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(texts):  # texts of about STRETCH bytes together, or one that is longer
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + STRETCH, "right")) - 1)
                h, stop = _shingled(data[offsets[begin] : offsets[end]], offsets[begin + 1 : end + 1].astype(np.int64) - offsets[begin])
                m = np.diff(stop, prepend=0)
                if least is not None:
                    first = m + (num * -m) // den + 1
                    first[m == 0] = 0
                    ranks = rank(h) if len(known) else np.full(len(h), -1)
                    some = np.concatenate(([0], np.cumsum(ranks >= 0)))
                    lists = []
                    for a, b, n, c in zip((stop - m).tolist(), stop.tolist(), first.tolist(), (some[stop] - some[stop - m]).tolist()):
                        part = h[a:b]
                        if c:
                            told_off = ranks[a:b] >= 0
                            part = part[~told_off] if b - a - c >= n else np.concatenate((part[~told_off], part[told_off][np.argsort(ranks[a:b][told_off])]))
                        lists.append(part[:n])
                    h, stop = np.concatenate(lists), np.cumsum(first)
                at = np.flatnonzero(m)
                columns = []
                if outlined:
                    bits = np.zeros((len(m), OUTLINE), bool)
                    bits[np.repeat(np.arange(len(m)), m), h % _U(OUTLINE)] = True
                    longs = pa.array(np.packbits(bits[at], axis=1).view(np.int64).ravel())
                    columns = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(OUTLINE // 64)), longs)]
                flat = pa.array(h.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + at)), pa.array(m[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stop[at])).astype(np.int32)), flat), *columns], names)
                begin = end

    rows = df.select(F.col(key).cast("long").alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, m int, s array<long>" + ", outline array<long>" * outlined)


def common_shingles(df: DataFrame, key: str, text: str) -> np.ndarray:
    """Hashes of shingles that many texts hold, by a part of the texts, rarest first; COMMON at most."""
    part = df.filter(F.pmod(F.xxhash64(key), F.lit(EVERY)) == 0)
    counts = shingles(part, key, text).select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN)
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()  # bounded
    return found["h"].to_numpy()[::-1].view(np.uint64).copy()


def near_links(df: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """Links (a, b) that tie all texts together whose shingle sets reach the Jaccard similarity: an exact prefix-filter join.

    A set's shingles are in one order for all sets. Two sets of the similarity share a shingle among the first
    |s| - ceil(least * |s|) + 1 of both, so only these are indexed, and of these only shingles that several
    sets hold. The order is that of the hashes, with common shingles last: which ones these are is told by a part of the texts
    and decides how long the lists get, never what is found. A pair meets in the list of such a shingle if the sets' lengths,
    and what is left of both behind the shingle's places, allow the similarity. Each list is held against its least key first,
    which is linear; then members of unlike classes meet in it, so that a list of near copies costs no pairs. Rows of a list,
    and of a text with many partners, that are many are dealt to several tasks. Whole sets are made only of texts that are in a pair,
    and are put beside each other only where their outlines of OUTLINE bits leave room for the similarity.
    Keys are longs, one row each.
    """
    ratio = Fraction(str(least))
    num, den = ratio.numerator, ratio.denominator
    first = write_table(shingles(df, key, text, common_shingles(df, key, text), ratio), "first")
    index = first.select("key", "m", F.posexplode("s").alias("at", "h")).withColumn("at", F.col("at") + 1)
    several = write_table(index.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    index = write_table(salted_join(index, several.select("h"), "h", hot_keys(several, "h", total)), "prefixes")
    drop_table(first, several)
    lists = index.groupBy("h").agg(F.min(F.struct("key", "m", "at")).alias("low"), F.count("*").alias("n"))
    member = write_table(salted_join(index, lists, "h", hot_keys(lists, "h", total)), "members")

    def may(a: Column, at: Column, b: Column, to: Column) -> Column:
        """Lengths a and b, with a common first shingle at the places at and to, allow the similarity."""
        left = F.least(a - at, b - to) + 1
        return (den * F.least(a, b) >= num * F.greatest(a, b)) & ((num + den) * left >= num * (a + b))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = write_table(pairs.distinct(), "pairs")
        ends = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
        sets = write_table(shingles(df.select(F.col(key).cast("long").alias(key), text).join(ends, key, "left_semi"), key, text, outlined=True), "sets")

        def beside(pairs: DataFrame, column: str) -> DataFrame:
            count = pairs.count()
            known = sets.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key", "left_semi")
            for end in ("a", "b"):
                mine = known.select(F.col("key").alias(end), F.col("m").alias(f"m{end}"), F.col(column).alias(f"s{end}"))
                pairs = salted_join(pairs, mine, end, hot_keys(pairs.groupBy(end).agg(F.count("*").alias("n")), end, count))
            return pairs

        def without(x: str, y: str) -> Column:
            """At least so many shingles has one text that the other has not: a bit that only one outline has."""
            return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, bits: n + bits)

        def enough(same: Column) -> Column:
            return (num + den) * same >= num * (F.col("ma") + F.col("mb"))

        most = F.least(F.col("ma") - without("sa", "sb"), F.col("mb") - without("sb", "sa"))
        kept = write_table(beside(pairs, "outline").filter(enough(most)).select("a", "b"), "kept")
        out = write_table(beside(kept, "s").filter(enough(F.size(F.array_intersect("sa", "sb")))).select("a", "b"), "links")
        drop_table(pairs, sets, kept)
        return out

    low = F.col("low")
    stars = member.filter((F.col("key") > low["key"]) & may(F.col("m"), F.col("at"), low["m"], low["at"])).select(low["key"].alias("a"), F.col("key").alias("b"))
    links = verified(stars)
    rooted = member.join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).drop("low", "n")
    rooted = write_table(rooted, "rooted")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).filter("r0 < r1").select("h", "n")
    held = salted_join(rooted, mixed, "h", hot_keys(mixed, "h", total))
    end = lambda x: held.select("h", "n", *[F.col(c).alias(f"{c}{x}") for c in ("key", "root", "m", "at")])
    met = sized_join(end("a"), end("b"), "h", "n", total).filter((F.col("roota") < F.col("rootb")) & may(F.col("ma"), F.col("ata"), F.col("mb"), F.col("atb")))
    more = verified(met.select(F.col("keya").alias("a"), F.col("keyb").alias("b")))
    out = write_table(links.union(more), "links")
    drop_table(index, member, links, more, rooted)
    return out


def three_signals(df: DataFrame, key: str, text: str, vectors: DataFrame | None = None, least_cosine: float = 0.95) -> DataFrame:
    """Every row with the least key of its class: equal hash, near text, or near vector (vectors: key, vector; all that can be near are compared)."""
    hashes = write_table(df.select(key, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("h")), "hashes")
    exact = write_table(exact_groups(hashes, key, F.col("h")), "exact")
    drop_table(hashes)
    same = F.col(key) == F.col("first")
    few = 2 * exact.filter(same).count() < exact.count()  # the shorter list of keys is the one that is joined
    near = near_links(df.filter(F.col(key).isNotNull()).join(exact.filter(same if few else ~same).select(key), key, "left_semi" if few else "left_anti"), key, text)
    links = near.union(exact.select(F.col("first").alias("a"), F.col(key).alias("b")))
    if vectors is not None:
        links = links.union(cosine_links(vectors, "key", "vector", least_cosine))
    roots = write_table(components(links), "roots")
    drop_table(exact, near)
    return df.select(key).join(roots, F.col(key) == F.col("node"), "left").select(key, F.coalesce("root", key).alias("first"))


#: Least and most vectors in a block of all_cosine_pairs, and rows of it that are held at once; vectors in the sample that gives the pivots, most pivots and annuli of one, and files of the blocks.
BLOCK, LARGE, HELD, SAMPLE, PIVOTS, ANNULI, FILES = 512, 8192, 256, 2048, 128, 64, 48


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _padded(vectors: pa.Array, width: int) -> np.ndarray:
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors about which the sample gathers, by a few rounds of spherical means."""
    points, centres = _unit(sample), _unit(sample)[:count]
    for _ in range(4):
        near = (points @ centres.T).argmax(1)
        sums = np.stack([points[near == c].sum(0) for c in range(len(centres))])
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def _with_cosine(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    size = dot(F.col("v"), F.col("v"))
    return rows.filter(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).filter((size > 0) & (size < float("inf")))


def cosine_blocks(df: DataFrame, key: str, vector: str, least: float, block: int | None = None, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of vectors (cell, salt, d, p, low, high, apart, k, v: keys and vectors as bytes), written, and the pairs of them that can hold a cosine of `least`.

    Vectors are unit vectors in balls about pivots, cut into annuli by their angle from the pivot. By the triangle
    inequality of angles, vectors of two annuli are at least the pivots' angle less both outer ones apart, or one's
    inner angle less the pivots' and the other's outer one; a pair of blocks whose bound is beyond the angle of
    `least` never meets. No result depends on the pivots, which a bounded sample gives. A block knows its own inner and
    outer angle and its pivot's angles to all others, so the pairs are a product under a condition, in which each task
    reads two of FILES parts of the blocks: no block is shuffled for its pairs.
    """
    spark = df.sparkSession
    rows = write_table(_with_cosine(df, key, vector).withColumn("n", F.monotonically_increasing_id()), "vectors")
    count, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    block = block or min(LARGE, max(BLOCK, count // 64))  # what is read for pairs of blocks shrinks with their size
    sample = rows.select("v", F.xxhash64("n").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()  # bounded: the sample
    pivots = pivots or max(1, min(PIVOTS, round(count**0.5 / 16)))
    centres = _centres(_padded(sample, width), pivots) if count else np.ones((1, width))
    told = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                s = _unit(_padded(batch.column(1), width)) @ told.value.T
                near = s.argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(np.arccos(np.clip(s[np.arange(len(s)), near], -1, 1)))], ["k", "v", "n", "p", "angle"])

    placed = write_table(rows.mapInArrow(assign, "k long, v array<double>, n long, p int, angle double"), "placed")
    drop_table(rows)
    shares = [n / ANNULI for n in range(1, ANNULI)]
    cuts = {r.p: r.cuts[:: max(1, ANNULI * block // max(r.n, 1))] for r in placed.groupBy("p").agg(F.count("*").alias("n"), F.percentile_approx("angle", shares).alias("cuts")).collect()}  # a row a pivot
    known = spark.createDataFrame([(p, c) for p, c in cuts.items()], "p int, cuts array<double>")
    celled = placed.join(F.broadcast(known), "p").withColumn("cell", F.col("p") * ANNULI + F.size(F.filter("cuts", lambda c: c < F.col("angle"))))  # at most PIVOTS rows
    sizes = celled.groupBy("cell", F.size("v").alias("d")).agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    parts = F.broadcast(sizes.groupBy("cell").agg(F.max("salts").alias("salts")))  # at most PIVOTS * ANNULI rows
    salt = F.pmod(F.xxhash64("n"), F.col("salts")).cast("int").alias("salt")
    dealt = celled.join(parts, "cell").select("cell", salt, F.size("v").alias("d"), "p", "angle", "k", "v")
    packed = dealt.groupBy("cell", "salt", "d").applyInArrow(_pack(np.arccos(np.clip(centres @ centres.T, -1, 1))), "cell int, salt int, d int, p int, low double, high double, apart array<double>, k binary, v binary")
    blocks = write_table(packed.repartition(FILES), "blocks")
    drop_table(placed)
    other = blocks.select("cell", "salt", "d", "p", "low", "high", "k", "v").toDF("cell2", "salt2", "d2", "p2", "low2", "high2", "k2", "v2")
    apart = F.element_at("apart", F.col("p2") + 1)
    bound = F.greatest(apart - F.col("high") - F.col("high2"), F.col("low") - apart - F.col("high2"), F.col("low2") - apart - F.col("high"))
    once = (F.col("cell") < F.col("cell2")) | ((F.col("cell") == F.col("cell2")) & (F.col("salt") <= F.col("salt2")))
    near = (F.col("d") == F.col("d2")) & once & (bound <= float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-6)
    return blocks, blocks.join(other.hint("shuffle_replicate_nl"), near)


def all_cosine_pairs(df: DataFrame, key: str, vector: str, least: float, block: int | None = None) -> DataFrame:
    """Pairs (a < b) of any two rows whose cosine is at least `least` > 0, exactly: blocks that can hold such a pair meet.

    Keys are longs. A null key, a null vector or element, a vector of zeros, and vectors of unlike lengths have no cosine.
    No key or vector makes a large block. Where vectors gather nowhere all blocks can meet, and the work is that of all pairs.
    """
    _, met = cosine_blocks(df, key, vector, least, block)
    found = _both(met).mapInArrow(_meet(least), "a long, b long, s double")
    return found.select("a", "b", F.round("s", 6).alias("similarity"))


def cosine_links(df: DataFrame, key: str, vector: str, least: float, block: int | None = None) -> DataFrame:
    """Links (a, b) that tie the same rows together as the pairs of all_cosine_pairs: equal vectors meet others once, and two blocks give a forest of their pairs."""
    rows = write_table(_with_cosine(df, key, vector), "vectors")
    folded = write_table(exact_groups(rows, "k", F.col("v")), "folded")
    once = rows.join(folded.filter("k = first").select("k").distinct(), "k", "left_semi")
    blocks, met = cosine_blocks(once, "k", "v", least, block)
    found = _both(met).mapInArrow(_meet(least, True), "a long, b long")
    out = write_table(found.union(folded.filter("k > first").select(F.col("first").alias("a"), F.col("k").alias("b"))), "tied")
    drop_table(rows, folded, blocks)
    return out


def _both(met: DataFrame) -> DataFrame:
    same = ((F.col("cell") == F.col("cell2")) & (F.col("salt") == F.col("salt2"))).alias("same")
    return met.select(same, "d", "k", "v", "k2", "v2")


def _pack(apart: np.ndarray):
    def pack(block: pa.Table) -> pa.Table:
        keys, angles = block["k"].to_numpy(), block["angle"].to_numpy()
        vectors = block["v"].combine_chunks().flatten().to_numpy()
        told = {"low": pa.array([angles.min()]), "high": pa.array([angles.max()]), "apart": pa.array([apart[block["p"][0].as_py()]], pa.list_(pa.float64()))}
        return pa.table({**{c: block[c][:1] for c in ("cell", "salt", "d", "p")}, **told, "k": pa.array([keys.tobytes()], pa.binary()), "v": pa.array([vectors.tobytes()], pa.binary())})

    return pack


def _near(va: np.ndarray, vb: np.ndarray, least: float):
    """Places and cosines of the pairs of two blocks, HELD rows of the first at a time: products in single precision, with room for their rounding, tell which are computed in double."""
    room = np.float32(least - (va.shape[1] + 4) * 2.0**-23)
    sa, sb = (va * va).sum(1), (vb * vb).sum(1)
    ua, ub = ((v / np.sqrt(s)[:, None]).astype(np.float32) for v, s in ((va, sa), (vb, sb)))
    for at in range(0, len(va), HELD):
        s = ua[at : at + HELD] @ ub.T
        if not s.max() >= room:
            continue
        i, j = np.nonzero(s >= room)
        if len(i) * 16 > s.size:
            s = (va[at : at + HELD] @ vb.T) / np.sqrt(np.outer(sa[at : at + HELD], sb))
            i, j = np.nonzero(s >= least)
            yield i + at, j, s[i, j]
        else:
            i += at
            s = np.einsum("ij,ij->i", va[i], vb[j]) / np.sqrt(sa[i] * sb[j])
            there = s >= least
            yield i[there], j[there], s[there]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least key, key) that tie together what the pairs tie together, one a key that is not the least."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.split(ends.ravel(), 2)
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def _meet(least: float, forest: bool = False):
    def found(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                same, d, ka, va, kb, vb = (batch.column(c)[n] for c in range(6))
                ka, kb = (np.frombuffer(k.as_buffer(), np.int64) for k in (ka, kb))
                va, vb = (np.frombuffer(v.as_buffer(), np.float64).reshape(len(k), d.as_py()) for v, k in ((va, ka), (vb, kb)))
                for i, j, s in _near(va, vb, least):
                    a, b = ka[i], kb[j]
                    there = a < b if same.as_py() else a != b
                    yield np.minimum(a, b)[there], np.maximum(a, b)[there], s[there]
                yield None

    def pairs(batches):
        for one in found(batches):
            if one and len(one[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in one], ["a", "b", "s"])

    def links(batches):
        kept = []
        for one in found(batches):
            if one and len(one[0]):
                kept.append(_forest(*one[:2]))
            elif one is None and kept:  # a pair of blocks ends
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _forest(*(np.concatenate(c) for c in zip(*kept)))], ["a", "b"])
                kept = []

    return links if forest else pairs
