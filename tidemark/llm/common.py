"""What several corpus operators share: scans, Arrow batches, shared-folder tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.graph import components
from tidemark.operators.joins import hot_keys, salted_join, sized_join
from tidemark.tables import drop_table, shared_dir, write_table

__all__ = ["BATCH_ROWS", "by_bytes", "components", "drop_table", "hot_keys", "map_batches", "runs_of", "salted_join", "shared_dir", "sized_join", "table", "whole_groups", "write_table"]

#: Rows of one Arrow batch between the JVM and Python. Texts are processed whole, so this, times
#: the length of a long text, bounds what a Python worker holds.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(sizes: list[int], most: int = 2 << 20) -> list[slice]:
    """Stretches of neighbours whose sizes sum up to about `most`; a larger one is alone."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            out.append(slice(start, k))
            start, total = k, 0
        total += n
    return [*out, slice(start, len(sizes))] if sizes else []


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str, setup: Callable | None = None) -> DataFrame:
    """mapInArrow with a function of one batch. setup() runs once a task and its result is passed on.

    Spark reads the rows of a batch from a setting of the session when the job runs; it is set here.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches):
        extra = () if setup is None else (setup(),)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch, *extra)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def runs_of(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the runs of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new)))


def whole_groups(batches, keys: tuple[int, ...]):
    """Tables of sorted batches that never cut a run of equal keys. A run over many batches is put together once."""
    kept: list = []
    ends = lambda batch, n: [batch.column(k)[n].as_py() for k in keys]
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if ends(kept[0], 0) == ends(batch, batch.num_rows - 1):  # one run so far
            continue
        joined = pa.Table.from_batches(kept).combine_chunks()
        start, _ = runs_of([joined.column(k).to_numpy() for k in keys])
        yield joined.slice(0, int(start[-1]))
        kept = joined.slice(int(start[-1])).combine_chunks().to_batches()
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()
