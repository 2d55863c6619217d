"""Structured Streaming forms of the stateful operators; each transformation also runs on batch frames.

State is bounded everywhere: by a watermark, by a time-to-live, or by a window that closes. Operators with state
of their own are in stateful.py.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def as_instant(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant: a plain timestamp is read in the session's time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def weekly_counts(df: DataFrame, key: str, column: str = "ts", late: str = "2 days") -> DataFrame:
    """Tumbling weeks from Monday on (the epoch was a Thursday), late rows within the watermark included."""
    week = F.window(column, "7 days", "7 days", "4 days")
    return df.withWatermark(column, late).groupBy(week.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week_start"), key, "n")


def session_counts(df: DataFrame, key: str, column: str = "ts", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    return df.withWatermark(column, late).groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(df: DataFrame, keys: list[str], column: str = "ts", ttl: str = "30 days") -> DataFrame:
    """Rows whose keys were not seen within the time-to-live."""
    return df.withWatermark(column, ttl).dropDuplicatesWithinWatermark(keys)


SEEN = "dedup_hash string, first_seen timestamp, last_seen timestamp, times_seen long"


class SeenStore:
    """The seen store as a base and the batches after it: a micro-batch writes what it saw, not the store.

    base=<n> holds the counts of all batches up to the one of each run that its file folded.json names; batch=<run>=<n> those
    of one. A batch that is run again replaces its own folder, or is passed over where a base holds it, so each counts
    once. A run is one checkpoint: another checkpoint takes another name and adds to the store. One writer at a time; the
    folder's file system has to rename a folder in one step.
    """

    def __init__(self, spark: SparkSession, path: str, run: str, every: int = 32):
        """every: so many batches are folded into a new base."""
        if not run or "=" in run or "/" in run:
            raise ValueError("a run's name is not empty and holds no = and no /")
        self.spark, self.path, self.run, self.every = spark, path.rstrip("/"), run, every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict[str, int], dict[str, tuple[str, int]]]:
        """The number of the newest base (-1: none), the last batch of each run in it, and the whole batches that are not."""
        root = self._path(self.path)
        names = [f.getPath().getName() for f in self._files.listStatus(root)] if self._files.exists(root) else []
        base = max((int(n.split("=")[1]) for n in names if n.startswith("base=")), default=-1)
        folded = {}
        if base >= 0:
            told = self.spark.read.text(f"{self.path}/base={base}/folded.json", wholetext=True).first()
            folded = json.loads(told["value"])
        batches = {n: (n.split("=")[1], int(n.split("=")[2])) for n in names if n.startswith("batch=") and self._files.exists(self._path(f"{self.path}/{n}/_SUCCESS"))}
        return base, folded, {n: (run, k) for n, (run, k) in batches.items() if k > folded.get(run, -1)}

    def _rows(self, base: int, batches) -> DataFrame:
        parts = [f"{self.path}/{n}" for n in batches] + ([f"{self.path}/base={base}/rows"] if base >= 0 else [])
        rows = self.spark.read.schema(SEEN).parquet(*parts) if parts else self.spark.createDataFrame([], SEEN)
        return rows.groupBy("dedup_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))

    def read(self) -> DataFrame:
        base, _, batches = self._state()
        return self._rows(base, batches)

    def write(self, batch: DataFrame, number: int) -> None:
        """The foreachBatch sink; batch: dedup_hash, ts."""
        base, folded, batches = self._state()
        if number <= folded.get(self.run, -1):
            return
        counts = batch.groupBy("dedup_hash").agg(F.min("ts").cast("timestamp").alias("first_seen"), F.max("ts").cast("timestamp").alias("last_seen"), F.count("*").alias("times_seen"))
        counts.write.mode("overwrite").parquet(f"{self.path}/batch={self.run}={number}")
        if len(batches) + 1 >= self.every:
            self.fold()

    def fold(self) -> None:
        """A new base of all there is. The old one and its batches go once the new one stands; its readers must be done."""
        base, folded, batches = self._state()
        if not batches:
            return
        made = f"{self.path}/made-{uuid.uuid4().hex}"
        self._rows(base, batches).write.parquet(f"{made}/rows")
        for run, number in batches.values():
            folded[run] = max(number, folded.get(run, -1))
        out = self._files.create(self._path(f"{made}/folded.json"))
        out.write(bytearray(json.dumps(folded), "utf-8"))
        out.close()
        if not self._files.rename(self._path(made), self._path(f"{self.path}/base={base + 1}")):
            raise RuntimeError("the new base could not be put in place")
        for name in [*batches, f"base={base}"]:
            self._files.delete(self._path(f"{self.path}/{name}"), True)


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there into a memory table, as a scheduler's trigger would."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
