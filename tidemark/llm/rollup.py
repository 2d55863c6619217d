"""Token counts as delta-maintained rollups with idempotent batch commits.

A batch holds changes to documents' counts: inserts, deletes and revisions. Against the counts now in
force each change becomes signed rows (the old count taken off, the new one put on), whose sums are
the batch's delta; totals by source, language and tokenizer version are the sums of all deltas, and a hot
source costs one partial sum a task.

The log of counts is kept in buckets by document. A batch reads only the buckets its documents fall in, of
those only the rows of its documents, and nothing of batches that `compact` has folded into a base; so it
costs what it changes. Counts and totals read the last base and the batches after it.

A batch is written to a work folder and committed by one rename to `batch-<number>-<token>-<id>`. The number
is claimed first, by a file that one writer can create and that holds the writer's token; a batch counts
only while the claim on its number holds its token. A reader sees all of a batch or nothing, a batch that
died leaves no trace but its work folder, an id that is there already is not applied again, however often
its job is run, and of writers that race for one number, or that wake after their claim was given away,
only the claim's owner is seen; the others start anew from what it left.

Defined results: a document without key is left out, in any change; an insert of a known document
revises it; a delete or revision of an unknown one changes nothing; of several changes to one document
and tokenizer version in one batch the greatest `seq` holds, of equal ones the greatest by value; null
sources and languages are groups of their own; a null text has no tokens; groups without documents
leave the totals. Columns other than those named are never read.
"""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, hot_keys, map_batches, salted_join, shared_dir, table, write_table
from tidemark.llm.tokens import Encoder

TOKENIZERS = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")
GROUP = ("source", "lang", "tokenizer")
MEASURES = ("docs", "tokens", "bytes")
LOG = "doc_id long, tokenizer string, source string, lang string, tokens long, bytes long, live boolean, batch long, bucket int"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"
#: Buckets of the log; raise them with the corpus, for a new rollup only.
BUCKETS = 64
#: Seconds after which a claim that led to no batch may be given away.
STALE = 600
_NAME = re.compile(r"batch-(\d{8})-([0-9a-f]{32})-(.+)")
_BASE = re.compile(r"base-(\d{8})-[0-9a-f]{32}")


class Rollup:
    """A rollup kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))
        self._owned: set[str] = set()

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]

    def _owner(self, number: int) -> str | None:
        """The token in the claim on a number."""
        claim = self._at(f"{self.path}/_number-{number:08d}")
        try:
            stream = self._fs.open(claim)
        except Exception:  # there is none
            return None
        try:
            return stream.readLine()
        finally:
            stream.close()

    def _committed(self) -> list[tuple[int, str, str]]:
        """Number, id and folder of every batch whose token holds the claim on its number."""
        out = []
        for name in self._names():
            if m := _NAME.fullmatch(name):
                if name not in self._owned and self._owner(int(m[1])) != m[2]:
                    continue
                self._owned.add(name)  # a claim behind a batch is never given away
                out.append((int(m[1]), m[3], name))
        return sorted(out)

    def batches(self) -> dict[str, int]:
        """Committed batch ids and their numbers."""
        return {batch: number for number, batch, _ in self._committed()}

    def _folders(self) -> tuple[list[str], int]:
        """The last base and the batches after it, and the number they reach to."""
        base = max((n for n in self._names() if _BASE.fullmatch(n)), default=None)
        upto = int(_BASE.fullmatch(base)[1]) if base else 0
        after = [(number, name) for number, _, name in self._committed() if number > upto]
        return [*([base] if base else []), *(name for _, name in after)], max([upto, *(number for number, _ in after)])

    def _read(self, part: str, schema: str) -> DataFrame:
        rows = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{part}") for name in self._folders()[0]]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], schema)

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _in_force(self, log: DataFrame) -> DataFrame:
        value = F.struct("batch", "source", "lang", "tokens", "bytes", "live")
        return log.groupBy("doc_id", "tokenizer").agg(F.max(value).alias("v")).filter("v.live").select("doc_id", "tokenizer", "v.source", "v.lang", "v.tokens", "v.bytes", "v.batch")

    def counts(self) -> DataFrame:
        """The counts in force: the latest entry of each document and tokenizer version, if it lives."""
        return self._in_force(self._read("log", LOG)).drop("batch")

    def changed(self, keys: DataFrame) -> DataFrame:
        """The counts in force of the documents in keys (doc_id): other buckets are not read, other rows not grouped."""
        buckets = [r.b for r in keys.select(self._bucket("doc_id").alias("b")).distinct().collect()]  # at most `buckets` rows
        log = self._read("log", LOG).filter(F.col("bucket").isin(buckets))
        return self._in_force(log.join(keys.select("doc_id").distinct(), "doc_id", "left_semi")).drop("batch")

    def totals(self) -> DataFrame:
        sums = [F.sum(m).alias(m) for m in MEASURES]
        return self._read("delta", DELTA).groupBy(*GROUP).agg(*sums).filter("docs <> 0")

    def compact(self) -> None:
        """Fold everything committed into a new base. Batches keep their names, so their ids stay known; readers go on with what they listed."""
        _, upto = self._folders()
        if not upto:
            return
        token = uuid.uuid4().hex
        work = f"{self.path}/_work-{token}"
        log = self._in_force(self._read("log", LOG)).withColumn("live", F.lit(True)).withColumn("bucket", self._bucket("doc_id"))
        log.repartition("bucket").write.partitionBy("bucket").parquet(f"{work}/log")
        self.totals().write.parquet(f"{work}/delta")
        self._fs.rename(self._at(work), self._at(f"{self.path}/base-{upto:08d}-{token}"))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes (op: insert, delete or revise; doc_id, tokenizer, source, lang, tokens, bytes, and seq if there)
        as batch `batch`. False, and nothing done, if it is committed already."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch id holds letters, digits, . _ and - only: {batch!r}")
        while batch not in (known := self.batches()):
            number = max(known.values(), default=0) + 1
            token = uuid.uuid4().hex
            work = f"{self.path}/_work-{token}"
            self._write(work, number, changes)
            if self._commit(work, number, token, batch):
                return True
            time.sleep(2)  # another writer has the number
        return False

    def _write(self, work: str, number: int, changes: DataFrame) -> None:
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        value = F.struct(seq.alias("seq"), F.col("tokens").cast("long").alias("tokens"), F.col("bytes").cast("long").alias("bytes"), "source", "lang", "op")
        last = changes.filter("doc_id is not null and op in ('insert', 'delete', 'revise')").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer").agg(F.max(value).alias("new"))
        last = write_table(last, "last")
        old = self.changed(last).select("doc_id", "tokenizer", F.struct("source", "lang", "tokens", "bytes").alias("old"))
        met = last.join(old, ["doc_id", "tokenizer"], "left").filter("old is not null or new.op = 'insert'")
        gone = F.col("new.op") == "delete"
        pick = lambda c: F.when(gone, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        signed = F.array_compact(
            F.array(
                F.when(F.col("old").isNotNull(), self._signed("old", -1)),
                F.when(~gone, self._signed("new", 1)),
            )
        )
        log = met.select(
            "doc_id", "tokenizer", pick("source").alias("source"), pick("lang").alias("lang"), pick("tokens").alias("tokens"), pick("bytes").alias("bytes"),
            (~gone).alias("live"), F.lit(number).cast("long").alias("batch"), self._bucket("doc_id").alias("bucket"), signed.alias("signed"),
        )
        log = write_table(log, "changes")
        log.drop("signed").repartition("bucket").write.partitionBy("bucket").parquet(f"{work}/log")
        rows = log.select("tokenizer", F.explode("signed").alias("s"))
        delta = rows.groupBy(F.col("s.source").alias("source"), F.col("s.lang").alias("lang"), "tokenizer").agg(*[F.sum(f"s.{m}").alias(m) for m in MEASURES])
        delta.write.parquet(f"{work}/delta")
        drop_table(last, log)

    @staticmethod
    def _signed(side: str, sign: int):
        c = lambda name: F.coalesce(F.col(f"{side}.{name}"), F.lit(0)) * sign
        return F.struct(F.col(f"{side}.source").alias("source"), F.col(f"{side}.lang").alias("lang"), F.lit(sign).cast("long").alias("docs"), c("tokens").alias("tokens"), c("bytes").alias("bytes"))

    def _claim(self, number: int, token: str) -> bool:
        """Create the claim on a number; one that led to no batch is given away once it is old."""
        claim = self._at(f"{self.path}/_number-{number:08d}")
        try:
            stream = self._fs.create(claim, False)
        except Exception:  # another writer has it
            if self._fs.exists(claim) and number > max(self.batches().values(), default=0):
                age = self.spark._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(claim).getModificationTime()
                if age > STALE * 1000:
                    self._fs.delete(claim, False)
            return False
        stream.writeBytes(token)
        stream.close()
        return True

    def _commit(self, work: str, number: int, token: str, batch: str) -> bool:
        known = self.batches()
        name = f"batch-{number:08d}-{token}-{batch}"
        ours = batch not in known and number > max(known.values(), default=0) and self._claim(number, token)
        if ours and self._owner(number) == token and self._fs.rename(self._at(work), self._at(f"{self.path}/{name}")):
            return self._owner(number) == token  # a claim given away in between: the batch is not seen
        self._fs.delete(self._at(work), True)
        return False


def _tidy(text: str) -> str:
    """Runs of blanks as one, none at a line's end, and a line that repeats the one before it left out."""
    if "  " in text or "\t" in text:  # else there is nothing to make one
        text = re.sub(r"[ \t]+", " ", text)
    if " \n" in text or text.endswith(" "):
        text = re.sub(r" +(?=\n|$)", "", text)
    lines = text.split("\n")
    return "\n".join(line for n, line in enumerate(lines) if not n or line != lines[n - 1])


def counted(docs: DataFrame, tokenizers=TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, copy (hash of the text), tokenizer, tokens, bytes, and tidy_tokens, tidy_bytes where tidying changes the text."""
    paths = {name: public_tokenizers.path(name) for name in tokenizers}

    def run(batch, encoders):
        rows: list = [[] for _ in range(9)]
        for doc, source, lang, copy, text in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            tidy = _tidy(text)
            tidy_raw = tidy.encode() if tidy != text else None
            for name, encoder in encoders.items():
                n = len(encoder.encode(text, raw)) // 4
                m = len(encoder.encode(tidy, tidy_raw)) // 4 if tidy_raw is not None else None
                for column, v in zip(rows, (doc, source, lang, copy, name, n, len(raw), m, None if tidy_raw is None else len(tidy_raw))):
                    column.append(v)
        s, i = pa.string(), pa.int64()
        names = ["doc_id", "source", "lang", "copy", "tokenizer", "tokens", "bytes", "tidy_tokens", "tidy_bytes"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (i, s, s, s, s, i, i, i, i))], names)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.sha2(text, 256), text)
    schema = "doc_id long, source string, lang string, copy string, tokenizer string, tokens long, bytes long, tidy_tokens long, tidy_bytes long"
    return map_batches(rows, run, schema, lambda: {name: Encoder(path) for name, path in paths.items()})


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: every document inserted, all but one of equal texts deleted, counts revised where
    tidying blanks and repeated lines changes a text, and the first two run again (which changes nothing)."""
    counts = write_table(counted(table(spark, sf_dir, "documents")), "counts")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    with_op = lambda df, op: df.withColumn("op", F.lit(op))
    first = counts.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    hot = hot_keys(first, "copy", counts.count())
    copies = salted_join(counts, first.select("copy", "first"), "copy", hot).filter("doc_id > first").drop("first")
    tidied = counts.filter("tidy_tokens is not null").withColumns({"tokens": F.col("tidy_tokens"), "bytes": F.col("tidy_bytes")})
    batches = {"load": with_op(counts, "insert"), "copies": with_op(copies, "delete"), "tidy": with_op(tidied, "revise")}
    for name in ("load", "copies", "tidy", "load", "copies"):
        rollup.apply(name, batches[name])
    return rollup.totals()


QUERIES = {"op8_token_rollup": op8_token_rollup}
ORACLES: dict[str, str] = {}
