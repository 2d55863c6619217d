"""Language-model scores of whole documents: a gated recurrent model over the corpus's own counts.

All documents are counted: words by occurrence, in all documents and in those that may be learnt from. The most
frequent words (HOT, by occurrence; keys of at most LONGEST bytes, so the broadcast's size is bounded) are told to
every task; the rest meet their counts in a join by word, where no word is frequent. The model (gru.py) predicts
the SYMBOLS most frequent training words, the document's end, and one symbol for all other words, whose own
probability is that of the counts: (c + 1) / (their total + their number + 1). A document's score is the sum over
its tokens, with the state carried through the whole document.

Training passes once over all documents that may be learnt from, in rounds: each task runs truncated
backpropagation over its share from the model of the round before, and the models are averaged by grouped
shuffle, weighted by tokens. Every document belongs to one round by its number's hash. What a round moves is one
model a task; the model's size is bounded by the parameters.

Defined results: a null text is empty, and has one token, its end; a null key is not held out (it is learnt from);
rows that repeat count and are scored each. Without documents to learn from every count is 0: the base score is 0,
and the model gives each of its two symbols a half to start with. No documents give no rows. Words are compared by bytes, so text of
any encoding will do; only A to Z are lowered. Other columns are never read.
"""

from __future__ import annotations

import copy
import hashlib
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, table, write_table
from tidemark.llm.gru import END, REST, Model

HOT, LONGEST = 200_000, 64
SYMBOLS, CLASS, HIDDEN = 576, 24, 16
ROUNDS, LANES, STEPS, RATE = 2, 512, 32, 0.05
#: Tokens that a task lays out at a time, twice as many at its end.
TOKENS = 1 << 21
#: Words that a task counts before it passes them on.
COUNTED = 600_000
SLICES = 64


def words(text: bytes) -> list[bytes]:
    """The words of a text, as keys: those of over LONGEST bytes by their digest, which no text holds (it starts with a byte that UTF-8 lacks)."""
    out = text.lower().split()  # of bytes: A to Z, and white space of ASCII
    if len(text) > LONGEST and out and max(map(len, out)) > LONGEST:
        out = [w if len(w) <= LONGEST else b"\xff" + hashlib.sha256(w).digest() for w in out]
    return out


def held_out(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(7)) == 2, F.lit(False))


def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), held_out(key).alias("held"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def _batches(spark: SparkSession, rows: int = 256) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def counted(rows: DataFrame) -> DataFrame:
    """word, n (occurrences), c (those in documents to learn from) over all of `texts`."""

    def count(batches):
        every, held = Counter(), Counter()

        def told():
            n = np.fromiter(every.values(), np.int64, len(every))
            out = pa.RecordBatch.from_arrays([pa.array(every.keys(), pa.binary()), pa.array(n), pa.array(n - np.fromiter(map(held.get, every, itertools.repeat(0)), np.int64, len(every)))], ["word", "n", "c"])
            every.clear(), held.clear()
            return out

        for batch in batches:
            for out, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                every.update(found)
                if out:
                    held.update(found)
                if len(every) > COUNTED:
                    yield told()
        if every:
            yield told()

    found = rows.select("held", "text").mapInArrow(count, "word binary, n long, c long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words and c of those that occur oftenest, `most` at most: whole bins of like numbers of occurrences, from the top."""
    binned = counts.withColumn("bin", F.floor(F.log2(F.col("n").cast("double")) * 64))
    least, total = None, 0
    for r in sorted(binned.groupBy("bin").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.bin):  # 64 bins a doubling
        total += r.words
        if total > most:
            break
        least = r.bin
    if least is None:
        return []
    found = binned.filter(F.col("bin") >= least).select("n", "word", "c").toArrow()
    return [(w, c) for _, w, c in sorted(zip(*(found.column(k).to_pylist() for k in range(3))), key=lambda x: (-x[0], x[1]))]


class Told:
    """The broadcast words: number, log10(c + 1), whether known, and the model's symbol; the last number is that of all other words."""

    def __init__(self, hot: list, ends: int, symbols: int):
        self.number = {w: k for k, (w, _) in enumerate(hot)}
        self.other = len(hot)
        c = np.array([c for _, c in hot], np.int64)
        best = np.lexsort((np.arange(len(c)), -c))[: symbols - 2]
        best = best[c[best] > 0]
        self.log = np.append(np.log10(c + 1.0), 0.0)
        self.known = np.append(c > 0, False)
        self.symbol = np.full(len(hot) + 1, REST, np.uint16)
        self.symbol[best] = np.arange(2, 2 + len(best))
        self.end = np.log10(ends + 1.0), ends > 0
        self.named = len(best), int(c[best].sum())
        self.counts = np.concatenate(([ends, 0], c[best]))


def numbered(rows: DataFrame, told) -> DataFrame:
    """Each document's row, key, held, n_tokens, n_known, logs (sum of log10(c + 1)), rest (of REST's words), n_rest, ids (symbols), and its rare words with their times."""
    schema = f"row long, key {rows.schema['key'].dataType.simpleString()}, held boolean, n_tokens long, n_known long, logs double, rest double, n_rest long, ids binary, rare array<struct<word:binary,times:int>>"

    def number(batches):
        t = told.value
        for batch in batches:
            out: list = [[] for _ in range(6)]
            rare_words, rare_times, ends = [], [], [0]
            for text in batch.column(3):
                found = words(text.as_py())
                at = np.fromiter(map(t.number.get, found, itertools.repeat(t.other)), np.int64, len(found))
                symbol, log = t.symbol[at], t.log[at]
                rest = symbol == REST
                rare = Counter(map(found.__getitem__, np.flatnonzero(at == t.other).tolist()))
                rare_words.extend(rare.keys())
                rare_times.extend(rare.values())
                ends.append(len(rare_words))
                row = (len(found) + 1, int(t.known[at].sum()) + t.end[1], float(log.sum()) + t.end[0], float(log[rest].sum()), int(rest.sum()), np.append(symbol, np.uint16(END)).tobytes())
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary())
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int32())], ["word", "times"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(out, kinds)], rare], ["row", "key", "held", "n_tokens", "n_known", "logs", "rest", "n_rest", "ids", "rare"])

    return rows.select("row", "key", "held", "text").mapInArrow(number, schema)


def _laid(batches, column: int):
    """Batches joined to lists of (batch parts, documents) of about TOKENS tokens.

    Documents longer than a lane's share of these wait for one another, the last of them for the other documents' rest: a
    lay-out takes as many steps as its longest document, so with one in each most steps would be of a few lanes.
    """
    held, docs, total = ([], []), ([], []), [0, 0]
    for batch in batches:
        late = np.asarray(pc.binary_length(batch.column(column))) > TOKENS // LANES * 2
        for kind, mask in enumerate((~late, late)):
            part, start = batch.filter(pa.array(mask)), 0
            for n, ids in enumerate(part.column(column)):
                doc = np.frombuffer(ids.as_buffer(), np.uint16)
                docs[kind].append(doc)
                total[kind] += len(doc)
                if total[kind] >= TOKENS:
                    yield [*held[kind], part.slice(start, n + 1 - start)], docs[kind][:]
                    held[kind].clear(), docs[kind].clear()
                    total[kind], start = 0, n + 1
            if start < part.num_rows:
                held[kind].append(part.slice(start))
    if docs[0] or docs[1]:
        yield [*held[0], *held[1]], [*docs[0], *docs[1]]


def train(ids: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The model after one pass over `ids` (row, ids), dealt to rounds by row."""
    spark = ids.sparkSession
    for n in range(rounds):
        told = spark.sparkContext.broadcast(model)

        def learn(batches, told=told):
            own, memory, seen = copy.deepcopy(told.value), {}, 0
            for _, docs in _laid(batches, 0):
                seen += own.learn(docs, LANES, STEPS, RATE, memory)
            if seen:
                parts = np.array_split(own.flat(), SLICES)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([seen] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "tokens", "part"])

        def average(t):
            weight = t["tokens"].to_numpy().astype(float)
            total = sum(w * np.frombuffer(p.as_buffer(), np.float32).astype(float) for w, p in sorted(zip(weight.tolist(), t["part"]), key=lambda x: (x[0], x[1].as_py())))
            return pa.table({"slice": t["slice"][:1], "part": pa.array([(total / weight.sum()).tobytes()], pa.binary())})

        share = ids.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == n).select("ids")
        found = share.mapInArrow(learn, "slice int, tokens long, part binary").groupBy("slice").applyInArrow(average, "slice int, part binary").collect()  # a model
        if found:
            model.load(np.concatenate([np.frombuffer(r.part) for r in sorted(found, key=lambda r: r.slice)]))
        told.unpersist()
    return model


def scored(ids: DataFrame, model: Model) -> DataFrame:
    """row, model: log10 probability of each document's symbols."""
    told = ids.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for parts, docs in _laid(batches, 1):
            rows = np.concatenate([p.column(0).to_numpy() for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(told.value.score(docs, LANES, STEPS))], ["row", "model"])

    return ids.select("row", "ids").mapInArrow(score, "row long, model double")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, symbols: int = SYMBOLS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = texts(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    _batches(spark)
    counts = write_table(counted(rows), "counts")
    ends = rows.agg(F.count_if(~F.col("held"))).first()[0]
    total, number = counts.agg(F.coalesce(F.sum("c"), F.lit(0)) + ends, F.count_if(F.col("c") > 0) + int(ends > 0)).first()
    words_ = Told(frequent(counts, hot), ends, symbols)  # bounded: hot words of LONGEST bytes
    told = spark.sparkContext.broadcast(words_)
    ids = write_table(numbered(rows, told), "symbols")

    _batches(spark)
    model = Model(words_.counts + np.array([0, max(0, total - ends - words_.named[1])] + [0] * words_.named[0]), HIDDEN, CLASS)
    model = train(ids.filter("not held").select("row", "ids"), model)
    found = scored(ids, model)

    rare = ids.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    rare = rare.join(counts.filter("c > 0").select("word", "c"), "word")
    rare = rare.groupBy("row").agg(F.sum("times").alias("r_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("r_logs"))
    out = ids.drop("ids", "rare").join(found, "row").join(rare, "row", "left")
    more = F.coalesce("r_logs", F.lit(0.0))
    base = F.col("logs") + more - F.col("n_tokens") * float(np.log10(total + number + 1))
    within = max(0, total - ends - words_.named[1]) + max(0, number - int(ends > 0) - words_.named[0]) + 1
    own = F.col("model") + F.col("rest") + more - F.col("n_rest") * float(np.log10(within))
    return out.select(F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), own.alias("score"))


def op13_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op13_recurrent_lm": op13_recurrent_lm}
ORACLES: dict[str, str] = {}
