"""Exact removal of repeated byte strings by prefix-free parsing.

Removed is every byte covered by a `min_bytes`-byte string that also starts earlier in the corpus
(smaller key, or same row and earlier start). That asks for the order of the corpus's suffixes to
`min_bytes` letters: suffixes equal to that depth stand in one run, the first place of a run stays.

1. Rolling-hash triggers (phrases.py) cut each text into phrases that hold each such string exactly
   once, so the corpus is a dictionary of distinct phrases and a parse, the places where they occur.
2. Texts are dealt to blocks of about `BLOCK_BYTES`. A block names each trigger it holds once, with its
   counts; triggers that occur once in the corpus hold no repeat, and each block is told the others.
3. Blocks send their distinct phrases of those triggers on, each with its first place, dealt by trigger:
   equal strings have equal triggers, so all that has to be compared meets. A group of copies costs a
   phrase a block. A trigger of which the blocks hold more than `hot` phrases would be a large group of
   one task; its phrases are cut to single strings first, dealt by their own hash, so a string costs a
   row a block however common.
4. There the suffix array of the dictionary is made by letters (ranks of 8, 24, 72 and 100 letters, each
   from those before), the parse is sorted by phrase and place, and both combine into the corpus order:
   by dictionary rank, then by place. The first place of each run of equal strings is a fact.
5. Each block gets its facts back, and each string of a repeated trigger that is no fact goes.

Only triggers are hashes, and they only deal out work: strings are compared by their bytes. Nothing
is collected or broadcast; texts are shuffled once (the three steps over blocks share the exchange).

Defined results: a null text is empty; texts shorter than `min_bytes` stay whole; rows with an equal
key are at one place in the corpus order, so none of them repeats another; a null key comes first.
Other columns are never read. Memory: a block of texts (or its longest text), and a few thousand
phrases a worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import phrases
from tidemark.llm.common import BATCH_ROWS, table
from tidemark.llm.words import prefix, stretch_hash

MIN_BYTES = 100
BLOCK_BYTES = 8 << 20
#: Phrases (a distinct one a block) above which a trigger's phrases are cut to single strings, so that they meet in many tasks.
HOT = 1000
#: Phrases whose suffixes are sorted at once; whole triggers, so a few more at most.
SORTED = 8_000
NULL_KEY = -(2**63)
_U = np.uint64
DICTIONARY = "trigger long, bytes binary, row long, tie long, block long, place long"
FACTS = "block long, row long, tie long, place long, bits binary, marks binary"


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def _one(table_: pa.Table, column: str) -> int:
    return table_.column(column)[0].as_py()


def _count(min_bytes: int):
    """Of a block: its distinct triggers with how often they occur and (by hash) in how many distinct phrases."""

    def run(rows: pa.Table) -> pa.Table:
        seen = [(np.zeros(0, np.uint64),) * 2]
        for data, _, _, i0, i1, h in phrases.parse(_texts(rows.column("body")), min_bytes):
            seen.append((h, stretch_hash(prefix(np.frombuffer(data, np.uint8)), i0, i1 + min_bytes)))
        h, body = (np.concatenate(x) for x in zip(*seen))
        order = np.lexsort((body, h))
        h, body = h[order], body[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        new = np.append(True, (h[1:] != h[:-1]) | (body[1:] != body[:-1]))[: len(h)]
        n = np.diff(np.append(start, len(h)))
        several = np.add.reduceat(new.astype(np.int64), start) if len(h) else n
        return pa.table({"h": h[start].view(np.int64), "n": n, "phrases": several, "block": np.full(len(start), _one(rows, "block"), np.int64)})

    return run


def _repeated(hot: int):
    """Of triggers in order: those that occur more than once, for each block that holds them, and whether their blocks would send over `hot` phrases."""

    def told(h, n, several, block):
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        on = np.repeat(np.add.reduceat(n, start), size) > 1
        many = np.repeat(np.add.reduceat(several, start), size) > hot
        return pa.RecordBatch.from_arrays([pa.array(block[on]), pa.array(h[on]), pa.array(many[on])], ["block", "h", "hot"])

    def run(batches):
        kept: list = []  # parts of columns; of one trigger over many batches they are joined once
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append([batch.column(c).to_numpy() for c in ("h", "n", "phrases", "block")])
            if kept[0][0][0] == kept[-1][0][-1]:
                continue
            held = [np.concatenate(parts) for parts in zip(*kept)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last trigger may go on
            yield told(*(x[:cut] for x in held))
            kept = [[x[cut:] for x in held]]
        if kept:
            yield told(*(np.concatenate(parts) for parts in zip(*kept)))

    return run


def _lookup(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in the sorted array `known`, -1 where it is not there."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.searchsorted(known, h).clip(max=len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _dictionary(min_bytes: int):
    """Of a block and its repeated triggers: its distinct phrases with their first places, and the triggers themselves for the block's last step."""

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        columns: list = [[] for _ in range(6)]
        if rows.num_rows and marks.num_rows:
            block = _one(rows, "block")
            h = marks.column("h").to_numpy()
            order = np.argsort(h)
            known, hot = h[order], marks.column("hot").to_numpy()[order]
            row, tie = rows.column("row").to_pylist(), rows.column("tie").to_pylist()
            held: dict = {}

            def keep(trigger, body, k, place):
                old = held.get(body)
                if old is None or row[k] < old[0][1]:
                    held[body] = [(trigger, row[k], tie[k], place)]
                elif row[k] == old[0][1] and all(tie[k] != o[2] for o in old):
                    old.append((trigger, row[k], tie[k], place))

            for data, number, shift, i0, i1, t in phrases.parse(_texts(rows.column("body")), min_bytes):
                t = t.view(np.int64)
                at = _lookup(known, t)
                on = np.flatnonzero(at >= 0)
                for k, a, b, off, trigger, spread in zip(number[on].tolist(), i0[on].tolist(), i1[on].tolist(), shift[on].tolist(), t[on].tolist(), hot[at[on]].tolist()):
                    if spread:
                        for i in range(a, b + 1):
                            body = data[i : i + min_bytes]
                            keep(None, body, k, i + off)
                    else:
                        keep(trigger, data[a : b + min_bytes], k, a + off)
            for body, places in held.items():
                for trigger, r, t, place in places:
                    if trigger is None:
                        trigger = xxhash.xxh3_64_intdigest(body) - 2**63
                    for column, v in zip(columns, (trigger, body, r, t, block, place)):
                        column.append(v)
            # The block's triggers travel with it: a row without a place, dealt by its own hash.
            flagged = np.concatenate((known.view(np.uint8), np.packbits(hot))).tobytes()
            for column, v in zip(columns, (xxhash.xxh3_64_intdigest(flagged) - 2**63, flagged, len(known), 0, block, -1)):
                column.append(v)
        kinds = [pa.binary() if k == 1 else pa.int64() for k in range(6)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["trigger", "bytes", "row", "tie", "block", "place"])

    return run


def suffix_ranks(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Rank by letters of the `width`-letter strings that start at `at`, equal strings alike: the suffix array of
    `data` to this depth. Each round puts ranks of known depth side by side, so it compares letters, never hashes."""

    def ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        new = np.zeros(len(keys), np.uint64)
        new[1:] = keys[order][1:] != keys[order][:-1]
        out = np.empty(len(keys), np.uint64)
        out[order] = np.cumsum(new, dtype=np.uint64)
        return out

    padded = np.concatenate((data, np.zeros(width + 8, np.uint8)))
    n = len(data)
    word = np.zeros(n, np.uint64)
    depth = min(8, width)
    for k in range(depth):
        word = (word << _U(8)) | padded[k : n + k]
    rank = ranks(word)
    while depth < width:
        bits = int(rank.max(initial=0)).bit_length() or 1
        parts = min(3, 63 // bits)
        if parts < 2:
            raise ValueError("too many phrases are sorted at once")
        reach = min(width, parts * depth)
        last = reach == width
        start = at if last else np.arange(n)
        tail = np.concatenate((rank, np.zeros(width, np.uint64)))
        key = tail[start]
        offsets = [min(p * depth, reach - depth) for p in range(1, -(-reach // depth))]  # the last may overlap the one before
        for o in offsets:
            key = (key << _U(bits)) | tail[start + o]
        rank, depth = ranks(key), reach
        if last:
            return rank
    return ranks(rank[at])


def corpus_order(bodies: list[bytes], triggers: np.ndarray, row: np.ndarray, tie: np.ndarray, place: np.ndarray, min_bytes: int):
    """Of whole triggers' phrase places: their numbers and the packed bits of the strings first met there (None: all).

    The dictionary's suffix array and the parse, sorted by phrase and place, combine into the order of the
    places' strings; a string's first places are those of its least row, one for each of that row's texts.
    """
    codes: dict = {}
    phrase = np.array([codes.setdefault(b, len(codes)) for b in bodies])
    parse = np.lexsort((place, tie, row, phrase))
    p, r, t = phrase[parse], row[parse], tie[parse]
    lead = np.append(True, p[1:] != p[:-1])
    least = r[lead][np.cumsum(lead) - 1]
    again = np.append(False, (p[1:] == p[:-1]) & (r[1:] == r[:-1]) & (t[1:] == t[:-1]))
    parse = parse[(r == least) & ~again]  # later places of a phrase hold no first string
    # A trigger with one phrase has no other string to be equal to.
    own = np.empty(len(codes), np.int64)
    own[phrase] = triggers
    _, group, many = np.unique(own, return_inverse=True, return_counts=True)
    alone = many[group] == 1
    whole = parse[alone[phrase[parse]]]
    numbers, bits = whole.tolist(), [None] * len(whole)
    rest = parse[~alone[phrase[parse]]]
    if len(rest):
        distinct = list(codes)
        used = np.flatnonzero(~alone)
        size = np.array([len(distinct[k]) for k in used])
        data = np.frombuffer(b"".join(distinct[k] for k in used), np.uint8)
        start = np.cumsum(size) - size
        strings = size - min_bytes + 1
        first = np.cumsum(strings) - strings
        at = np.repeat(start - first, strings) + np.arange(strings.sum())
        rank = suffix_ranks(data, min_bytes, at)
        slot = np.zeros(len(codes), np.int64)
        slot[used] = np.arange(len(used))
        mine = slot[phrase[rest]]
        each = strings[mine]
        begin = np.cumsum(each) - each
        inside = np.arange(each.sum()) - np.repeat(begin, each)
        string = rank[np.repeat(first[mine], each) + inside]
        r, t = np.repeat(row[rest], each), np.repeat(tie[rest], each)
        where = np.repeat(place[rest], each) + inside
        order = np.lexsort((where, t, r, string))
        s, r, t = string[order], r[order], t[order]
        lead = np.append(True, s[1:] != s[:-1])
        least = r[lead][np.cumsum(lead) - 1]
        again = np.append(False, (s[1:] == s[:-1]) & (r[1:] == r[:-1]) & (t[1:] == t[:-1]))
        kept = np.empty(len(order), bool)
        kept[order] = (r == least) & ~again
        for k, b, n in zip(rest.tolist(), begin.tolist(), each.tolist()):
            part = kept[b : b + n]
            if part.any():
                numbers.append(k)
                bits.append(None if part.all() else np.packbits(part).tobytes())
    return numbers, bits


def _resolve(min_bytes: int, sorted_: int):
    """Of phrases dealt by trigger, in order: the facts; a block's triggers pass through."""

    def answer(part: pa.Table) -> pa.RecordBatch:
        place = part["place"].to_numpy()
        real = np.flatnonzero(place >= 0)
        passed = np.flatnonzero(place < 0)
        bodies = part["bytes"].take(pa.array(real)).to_pylist()
        row, tie, block, trigger = (part[c].to_numpy() for c in ("row", "tie", "block", "trigger"))
        numbers, bits = corpus_order(bodies, trigger[real], row[real], tie[real], place[real], min_bytes) if len(real) else ([], [])
        at = np.concatenate((real[np.array(numbers, np.int64)], passed)).astype(np.int64)
        marks = [None] * len(numbers) + part["bytes"].take(pa.array(passed)).to_pylist()
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c[at]) for c in (block, row, tie, place)), pa.array(bits + [None] * len(passed), pa.binary()), pa.array(marks, pa.binary())], [x.split()[0] for x in FACTS.split(", ")]
        )

    def run(batches):
        kept, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            n += batch.num_rows
            if n < sorted_ or kept[0]["trigger"][0] == batch["trigger"][batch.num_rows - 1]:  # few, or one trigger so far
                continue
            joined = pa.Table.from_batches(kept)
            triggers = joined["trigger"].to_numpy()
            cut = int(np.searchsorted(triggers, triggers[-1], "left"))  # the last trigger may go on
            yield answer(joined.slice(0, cut))
            kept = joined.slice(cut).combine_chunks().to_batches()
            n -= cut
        if kept:
            yield answer(pa.Table.from_batches(kept))

    return run


def _spans(size: int, marked: list, facts: dict, row: int, tie: int, min_bytes: int) -> list:
    """The removed spans of one text, from its phrases of repeated triggers [(first string, last string, hot)]."""
    edge = np.zeros(size + 1, np.int32)
    for a, b, spread in marked:
        if spread:
            gone = [i for i in range(a, b + 1) if (row, tie, i) not in facts]
        elif (row, tie, a) not in facts:
            edge[a] += 1
            edge[b + min_bytes] -= 1
            continue
        else:
            bits = facts[row, tie, a]
            if bits is None:
                continue
            gone = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a + 1) == 0) + a
        for i in gone:
            edge[i] += 1
            edge[i + min_bytes] -= 1
    covered = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    return np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2).tolist()


def _cut(min_bytes: int, keep: list[str], as_text: bool):
    """Of a block and its facts: the texts without the strings that are no facts."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        texts = _texts(rows.column("body"))
        row, tie = rows.column("row").to_pylist(), rows.column("tie").to_pylist()
        facts, known, hot = {}, np.zeros(0, np.int64), np.zeros(0, bool)
        for r, t, place, bits, marks in zip(*(told.column(c).to_pylist() for c in ("row", "tie", "place", "bits", "marks"))):
            if marks is None:
                facts[r, t, place] = bits
            else:  # the triggers: r says how many
                known = np.frombuffer(marks, np.int64, r)
                hot = np.unpackbits(np.frombuffer(marks, np.uint8, offset=8 * r), count=r).astype(bool)
        marked: list = [[] for _ in texts]
        for _, number, shift, i0, i1, h in phrases.parse(texts, min_bytes):
            at = _lookup(known, h.view(np.int64))
            on = np.flatnonzero(at >= 0)
            for k, a, b, spread in zip(number[on].tolist(), (i0 + shift)[on].tolist(), (i1 + shift)[on].tolist(), hot[at[on]].tolist()):
                marked[k].append((a, b, spread))
        kept, spans = [], []
        for body, parsed, r, t in zip(texts, marked, row, tie):
            found = _spans(len(body), parsed, facts, r, t, min_bytes) if parsed else []
            at, left = 0, []
            for a, b in found:
                left.append(body[at:a])
                at = b
            left.append(body[at:])
            kept.append(b"".join(left) if found else body)
            spans.append(found)
        if as_text:
            kept = [None if gone else body.decode("utf-8", "ignore") for body, gone in zip(kept, rows.column("absent").to_pylist())]
        made = {"key": rows.column("key"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "kept": pa.array(kept, pa.string() if as_text else pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32())))}
        return pa.table(made | {c: rows.column(c) for c in keep})

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, hot: int = HOT, block_bytes: int = BLOCK_BYTES, sorted_: int = SORTED, keep: tuple[str, ...] = (), as_text: bool = False
) -> DataFrame:
    """One row per row of docs: key, n_bytes, kept (the remaining bytes), spans (removed, as array<array<int>> of [start, end)), and the columns to keep.

    as_text: kept is a string, without the characters that an edge cuts, and null where the text is null.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    body = F.coalesce(F.col(text), F.lit(""))
    blocks = 1 + (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // block_bytes
    tie = F.xxhash64(body)
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("row"),
        tie.alias("tie"),
        F.pmod(F.xxhash64(F.col(key).cast("long"), tie), F.lit(blocks)).alias("block"),
        body.alias("body"),
        *([F.col(text).isNull().alias("absent")] if as_text else []),
        *[F.col(c).alias(f"keep{n}") for n, c in enumerate(keep)],
    )
    carried = [f"keep{n}" for n in range(len(keep))]
    counts = rows.groupBy("block").applyInArrow(_count(min_bytes), "h long, n long, phrases long, block long")
    marks = counts.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated(hot), "block long, h long, hot boolean")
    found = rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_dictionary(min_bytes), DICTIONARY)
    facts = found.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_resolve(min_bytes, sorted_), FACTS)
    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    out = rows.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(_cut(min_bytes, carried, as_text), f"key long, n_bytes long, kept {'string' if as_text else 'binary'}, spans array<array<int>>{more}")
    return out.select(F.col("key").alias(key), "n_bytes", "kept", "spans", *[F.col(f"keep{n}").alias(c) for n, c in enumerate(keep)])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
