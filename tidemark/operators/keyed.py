"""A keyed store of hash buckets: a merge reads and rewrites the buckets that its batch touches, and no others.

Files are never changed. A version is a manifest, a small JSON file that lists the files of each bucket with
their rows and key ranges; a merge writes new files for its buckets and commits the next manifest in one
atomic step that fails if there is one already. A writer that comes second takes up the winner's version: where
the two touched other buckets its files stand as they are, else it merges again. So no batch is lost, and a
reader stays on the version that it opened. A batch that carries a run and a number counts once, however often
it is written (a replayed micro-batch).

Parquet has no MERGE; the merge itself is a function of two frames, the old rows of the touched buckets and the
batch (operators/stores.py has them). Keys that are null form a bucket like any other; what they mean is up to
that function.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.tables import drop_table, shared_dir, write_table

Merge = Callable[[DataFrame, DataFrame], DataFrame]
#: Manifests that vacuum keeps.
KEPT = 2
#: Slices of a bucket's keys that tasks may write apart.
SLICES = 16


@dataclass(frozen=True)
class Merged:
    """What a merge did: its version, the buckets it rewrote, files read and written, and how often it had to start again."""

    version: int
    buckets: tuple[int, ...]
    read: tuple[str, ...]
    written: tuple[str, ...]
    retries: int


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, path: str, rows: DataFrame, keys: list[str], buckets: int = 64) -> KeyedStore:
        """Version 0, of rows with one row a key; buckets: as many as keep one to some 100 MB. There must be no store yet."""
        store = cls(rows.sparkSession, path)
        files = store._write(rows, keys, buckets)
        if not store._commit(0, {"keys": keys, "buckets": buckets, "schema": rows.schema.json(), "files": files, "runs": {}}):
            store._forget(files)
            raise FileExistsError(f"there is a store in {path}")
        return store

    # --- versions ---------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Of the given version, or the latest."""
        version = self.versions()[-1] if version is None else version
        stream = self._files.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {**json.loads(text), "version": version}

    def _commit(self, version: int, said: dict) -> bool:
        """Whether this writer's manifest became the version; false where there is one already."""
        folder, files = f"{self.path}/manifests", self._files
        files.mkdirs(self._path(folder))
        made, goal = self._path(f"{folder}/made-{uuid.uuid4().hex}"), self._path(f"{folder}/{version:012d}.json")
        out = files.create(made, False)
        out.write(bytearray(json.dumps(said), "utf-8"))
        out.close()
        jvm = self.spark._jvm
        try:
            if files.getUri().getScheme() == "file":  # a local rename would replace what is there; a link is refused
                local = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI("file", None, p.toUri().getPath(), None))
                jvm.java.nio.file.Files.createLink(local(goal), local(made))
            else:
                none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, goal, options)
            return True
        except Exception:
            if not files.exists(goal):
                raise
            return False
        finally:
            files.delete(made, False)

    # --- rows -------------------------------------------------------------------------------------------------

    @staticmethod
    def bucket(keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: list[str], buckets: int) -> list[dict]:
        """New files of the rows as the manifest lists them: few rows are one file a bucket, many are dealt to tasks by slices of it."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumns({"_bucket": self.bucket(keys, buckets), "_slice": F.pmod(F.hash(*keys), F.lit(SLICES))})
        dealt.repartition("_bucket", "_slice").drop("_slice").sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder) if self._any(folder) else None
        if written is None:
            return []
        file = F.col("_metadata.file_path").alias("file")
        if len(keys) == 1:  # least and greatest of a number or a date are held in place; those of structs would sort all rows
            key, text = F.col(keys[0]), lambda c: F.array(c.cast("string"))
            ends = written.select(file, key.alias("k")).groupBy("file").agg(F.count("*").alias("rows"), text(F.when(F.count("k") == F.count("*"), F.min("k"))).alias("low"), text(F.max("k")).alias("high"))
        else:
            told = written.select(file, F.struct(*keys).alias("k"), F.struct(*[F.col(k).cast("string").alias(k) for k in keys]).alias("t"))
            ends = told.groupBy("file").agg(F.count("*").alias("rows"), F.min_by("t", "k").alias("low"), F.max_by("t", "k").alias("high"))
        out = []
        for r in ends.collect():  # a row a file
            name = r.file[r.file.index("/data/") + 1 :]
            number = int(name.split("_bucket=")[1].split("/")[0])
            out.append({"bucket": number, "file": name, "rows": r.rows, "low": list(r.low), "high": list(r.high)})
        return sorted(out, key=lambda x: (x["bucket"], x["file"]))

    def _any(self, folder: str) -> bool:
        return any(f.getPath().getName().startswith("_bucket=") for f in self._files.listStatus(self._path(folder)))

    def _forget(self, files: list[dict]) -> None:
        for folder in {f["file"].split("/")[1] for f in files}:
            self._files.delete(self._path(f"{self.path}/data/{folder}"), True)

    def _rows(self, said: dict, files: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(said["schema"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f['file']}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the given version, or the latest; what is written afterwards does not show."""
        said = self.manifest(version)
        return self._rows(said, said["files"])

    def touched_by(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the buckets in which the given keys are, others of these buckets among them."""
        said = self.manifest(version)
        wanted = self._buckets(keys, said)
        return self._rows(said, [f for f in said["files"] if f["bucket"] in wanted])

    def lookup(self, *keys, version: int | None = None) -> DataFrame:
        """Rows of a few keys (each a value, or a tuple of them): files of other buckets are not opened."""
        said = self.manifest(version)
        schema = StructType.fromJson(json.loads(said["schema"]))
        rows = [k if isinstance(k, tuple) else (k,) for k in keys]
        asked = self.spark.createDataFrame(rows, StructType([schema[k] for k in said["keys"]]))
        wanted = self._buckets(asked, said)
        found = self._rows(said, [f for f in said["files"] if f["bucket"] in wanted])
        if len(said["keys"]) == 1:  # goes down to the scan, whose files are sorted by key
            return found.filter(F.col(said["keys"][0]).isin([r[0] for r in rows]))
        return found.join(F.broadcast(asked.distinct()), said["keys"], "left_semi")  # the keys of the call

    def _buckets(self, keys: DataFrame, said: dict) -> set[int]:
        schema = StructType.fromJson(json.loads(said["schema"]))
        own = keys.select(*[F.col(k).cast(schema[k].dataType) for k in said["keys"]])  # a hash tells types apart
        number = self.bucket(said["keys"], said["buckets"])
        return {r.b for r in own.select(number.alias("b")).distinct().collect()}  # at most a row a bucket

    # --- writing ----------------------------------------------------------------------------------------------

    def merge(self, batch: DataFrame, how: Merge, run: str | None = None, number: int = 0) -> Merged | None:
        """Rewrite the batch's buckets as how(their rows, the batch) has them. None where the run's batch is in the store already.

        how sees whole buckets only, so it may add, change and drop rows whose keys are in the batch's buckets.
        """
        said = self.manifest()
        own = write_table(batch, "batch")
        try:
            return self._rewrite(said, self._buckets(own, said), lambda old: how(old, own), run, number)
        finally:
            drop_table(own)

    def append(self, rows: DataFrame, run: str | None = None, number: int = 0) -> Merged | None:
        """Put rows beside those that are there; no file is read. None where the run's batch is in the store already.

        For stores whose rows of one key are combined by the reader; `fold` combines them for good.
        """
        said, written, retries = self.manifest(), None, 0
        while True:
            if run is not None and number <= said["runs"].get(run, -1):
                self._forget(written or [])
                return None
            if written is None:
                written = [f | {"added": True} for f in self._write(rows, said["keys"], said["buckets"])]
            if (version := self._next(said, said["files"] + written, run, number)) is not None:
                return Merged(version, tuple(sorted({f["bucket"] for f in written})), (), tuple(f["file"] for f in written), retries)
            said, retries = self.manifest(), retries + 1

    def fold(self, how: Callable[[DataFrame], DataFrame], most: int) -> Merged | None:
        """Rewrite, as how(their rows) has them, the buckets with more appended rows than others, or over `most` appended files. None where there are none."""
        said = self.manifest()
        rows, files = ({}, {}), {}
        for f in said["files"]:
            late, k = f.get("added", False), f["bucket"]
            rows[late][k] = rows[late].get(k, 0) + f["rows"]
            files[k] = files.get(k, 0) + late
        full = {k for k in files if rows[True].get(k, 0) > rows[False].get(k, 0) or files[k] > most}
        return self._rewrite(said, full, how) if full else None

    def _next(self, said: dict, files: list[dict], run: str | None, number: int) -> int | None:
        """The version after `said`, now of these files; None where another writer made it."""
        runs = said["runs"] | ({run: number} if run is not None else {})
        version = said["version"] + 1
        return version if self._commit(version, {**{k: said[k] for k in ("keys", "buckets", "schema")}, "files": files, "runs": runs}) else None

    def _rewrite(self, said: dict, wanted: set[int], how: Callable[[DataFrame], DataFrame], run: str | None = None, number: int = 0) -> Merged | None:
        written, base, retries = None, None, 0
        while True:
            if run is not None and number <= said["runs"].get(run, -1):
                self._forget(written or [])
                return None
            old = [f for f in said["files"] if f["bucket"] in wanted]
            if written is None or [f["file"] for f in old] != base:  # the first time, or others changed these buckets
                self._forget(written or [])
                schema = StructType.fromJson(json.loads(said["schema"]))
                rows = how(self._rows(said, old)).select(*[F.col(f.name).cast(f.dataType) for f in schema])
                written, base = self._write(rows, said["keys"], said["buckets"]) if wanted else [], [f["file"] for f in old]
                if any(f["bucket"] not in wanted for f in written):
                    self._forget(written)
                    raise ValueError("a merge made rows of buckets that its batch does not touch")
            files = [f for f in said["files"] if f["bucket"] not in wanted] + written
            if (version := self._next(said, files, run, number)) is not None:
                return Merged(version, tuple(sorted(wanted)), tuple(base), tuple(f["file"] for f in written), retries)
            said, retries = self.manifest(), retries + 1

    def vacuum(self, keep: int = KEPT) -> list[str]:
        """Drop all but the last versions, and the folders of files that none of them lists. Readers and writers of older ones must be done."""
        versions = self.versions()
        held = {f["file"].split("/")[1] for v in versions[-keep:] for f in self.manifest(v)["files"]}
        for v in versions[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        folder = self._path(f"{self.path}/data")
        gone = [n for f in (self._files.listStatus(folder) if self._files.exists(folder) else []) if (n := f.getPath().getName()) not in held]
        for name in gone:
            self._files.delete(self._path(f"{self.path}/data/{name}"), True)
        return gone


def temporary(rows: DataFrame, keys: list[str], buckets: int = 16) -> KeyedStore:
    """A store in the application's folder, which goes when the application ends."""
    return KeyedStore.create(f"{shared_dir(rows.sparkSession)}/store-{uuid.uuid4().hex}", rows, keys, buckets)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins: the batch's rows (one a key: the greatest by all columns) and the old ones of other keys."""
    rest = [c for c in old.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.select(*keys).distinct()
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one)
