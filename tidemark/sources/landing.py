"""A data source of landed files, for batches and streams: what fetchers and uploads left in a folder.

Layout: <path>/kind=<kind>/board=<board>/date=<yyyy-mm-dd>/<file>, names escaped as Spark's writers do it. Filters on
kind, board, date, file and size reach the source: files that they rule out are listed, not opened. Files are dealt to
tasks in groups of bounded bytes. Option columns names the columns wanted; without content no file is opened.

The stream's offset is the time and name of the last file taken in, in that order, so a restart repeats nothing; a
file has to land with a later time than those before it (renamed into place once it is whole).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not
from pyspark.sql.types import StructType

COLUMNS = {"kind": "string", "board": "string", "date": "date", "file": "string", "size": "long", "content": "binary"}
GROUP_BYTES = 32 << 20


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> Iterator[tuple[dict, str, int]]:
    """Each file's columns, its path and its time in nanoseconds, in order of time and path."""
    from pyarrow import fs

    system, root = _system(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path[len(root) :].strip("/").split("/")
        if info.type != fs.FileType.File or any(p.startswith(("_", ".")) for p in parts):
            continue
        named = dict(p.split("=", 1) for p in parts[:-1] if "=" in p)
        day = named.get("date")
        row = {"kind": unquote(named["kind"]) if "kind" in named else None, "board": unquote(named["board"]) if "board" in named else None, "date": dt.date.fromisoformat(day) if day and day[0].isdigit() else None, "file": parts[-1], "size": info.size}
        found.append((info.mtime_ns or 0, info.path, row))
    for at, where, row in sorted(found, key=lambda x: x[:2]):
        yield row, where, at


def _test(f: Filter):
    """The filter as a test of a file's columns, or None where the source does not know it."""
    if isinstance(f, Not):
        inner = _test(f.child)
        column = getattr(f.child, "attribute", (None,))[0]
        return inner and (lambda row: row[column] is not None and not inner(row))
    attribute = getattr(f, "attribute", None)
    if attribute is None or len(attribute) != 1 or attribute[0] not in COLUMNS or attribute[0] == "content":
        return None
    column, value = attribute[0], getattr(f, "value", None)
    tests = {
        EqualTo: lambda x: x == value, EqualNullSafe: lambda x: x == value, In: lambda x: x in value, GreaterThan: lambda x: x > value, GreaterThanOrEqual: lambda x: x >= value,
        LessThan: lambda x: x < value, LessThanOrEqual: lambda x: x <= value,
    }
    test = tests.get(type(f))
    if test is None:
        return None
    if isinstance(f, EqualNullSafe):
        return lambda row: row[column] == value
    return lambda row: row[column] is not None and test(row[column])


class _Reading:
    def __init__(self, path: str, columns: list[str], group: int):
        self.path, self.columns, self.group = path, columns, group

    def grouped(self, files: list[tuple[dict, str]]) -> list[Files]:
        out, held, total = [], [], 0
        for row, where in files:
            if held and total + row["size"] > self.group:
                out.append(Files(held))
                held, total = [], 0
            held.append((where, row))
            total += row["size"]
        return [*out, Files(held)] if held else out

    def rows(self, part: Files | None) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for where, row in part.rows if part else ():  # without files Spark reads one part that is none
            if "content" in self.columns:
                with system.open_input_stream(where) as stream:
                    row = row | {"content": stream.read()}
            yield tuple(row[c] for c in self.columns)


class LandedReader(_Reading, DataSourceReader):
    tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = [(f, _test(f)) for f in filters]
        self.tests = [t for _, t in known if t]
        return iter([f for f, t in known if not t])

    def partitions(self) -> list[Files]:
        return self.grouped([(row, where) for row, where, _ in listed(self.path) if all(t(row) for t in self.tests)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class LandedStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        last = self.initialOffset()
        for _, where, at in listed(self.path):
            last = {"at": at, "path": where}
        return last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return self.grouped([(row, where) for row, where, at in listed(self.path) if low < (at, where) <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def _columns(self) -> list[str]:
        wanted = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        if not set(wanted) <= set(COLUMNS):
            raise ValueError(f"columns are some of {', '.join(COLUMNS)}")
        return wanted

    def schema(self) -> str:
        return ", ".join(f"{c} {COLUMNS[c]}" for c in self._columns())

    def _parts(self) -> tuple[str, list[str], int]:
        return self.options["path"], self._columns(), int(self.options.get("group_bytes", GROUP_BYTES))

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(*self._parts())

    def streamReader(self, schema: StructType) -> LandedStream:
        return LandedStream(*self._parts())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedSource)


def files(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("landed").options(**options).load(path)


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("landed").options(**options).load(path)
