from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import cubes
from tidemark.operators.keyed import SLICES, KeyedStore
from tidemark.sources.binding import job_skills, jobs

SINCE, UNTIL = "1998-01-01", "1998-07-01"


def told(df):
    """Every cell once."""
    rows = [tuple(r) for r in df.select(*cubes.KEYS, "n").collect()]
    assert len({r[:-1] for r in rows}) == len(rows) and all(r[-1] for r in rows)
    return Counter({r[:-1]: r[-1] for r in rows})


def test_a_batch_reads_no_cells_and_a_small_one_rewrites_none(spark, sf_dir, tmp_path):
    half = (F.col("scraped_at") >= F.lit(SINCE).cast("timestamp_ntz")) & (F.col("scraped_at") < F.lit(UNTIL).cast("timestamp_ntz"))
    j, s = jobs(spark, sf_dir).filter(half), job_skills(spark, sf_dir)
    cube = cubes.DayCube.create(str(tmp_path / "cube"), j.filter("job_id % 11 <> 0"), s, buckets=4)
    base = {f["file"] for f in cube.store.manifest()["files"]}
    late = cubes.changes(j.limit(0), j.filter("job_id % 11 = 0"), s)
    done = cube.apply(late, "run", 0)
    assert done.read == () and base < {f["file"] for f in cube.store.manifest()["files"]}
    assert cube.apply(late, "run", 0) is None
    assert told(cube.days(SINCE, UNTIL)) == told(cubes.cells(j, s))
    moved = j.withColumn("scraped_at", F.expr("scraped_at + interval 1 day"))
    cube.apply(cubes.changes(j, moved, s), "run", 1)  # outgrows what is there, which is folded
    assert not base & {f["file"] for f in cube.store.manifest()["files"]} and not any(f.get("added") for f in cube.store.manifest()["files"])
    assert told(cube.days(SINCE, "1998-07-02")) == told(cubes.cells(moved, s)) == told(cube.store.read())
    cube.apply(cubes.changes(moved, j.limit(0), s), "run", 2)
    assert told(cube.days(SINCE, "1998-07-02")) == Counter()


def test_a_writer_that_comes_second_appends_too(spark, tmp_path):
    row = lambda k, n: spark.createDataFrame([(k, n)], "k long, n long")
    store = KeyedStore.create(str(tmp_path / "log"), row(1, 1), ["k"], 1)
    write, calls = store._write, []

    def slow(*what):
        calls.append(1)
        if len(calls) == 1:
            assert KeyedStore(spark, store.path).append(row(1, 5)).version == 1
        return write(*what)

    store._write = slow
    done = store.append(row(1, 7), "run", 0)
    assert done.version == 2 and done.retries == 1 and len(calls) == 1
    assert sorted(r.n for r in store.read().collect()) == [1, 5, 7]
    assert store.fold(lambda old: old.groupBy("k").agg(F.sum("n").alias("n")), 9).version == 3
    assert [tuple(r) for r in store.read().collect()] == [(1, 13)] and store.fold(lambda old: old, 9) is None


def test_a_bucket_of_many_rows_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = KeyedStore.create(str(tmp_path / "one"), spark.range(1000).toDF("k"), ["k"], 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = store.manifest()["files"]
    assert 1 < len(files) <= SLICES and sum(f["rows"] for f in files) == 1000
    assert min(int(f["low"][0]) for f in files) == 0 and max(int(f["high"][0]) for f in files) == 999
