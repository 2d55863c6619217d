import pytest
from pyspark.sql import functions as F

from tidemark.operators import stores
from tidemark.operators.keyed import KeyedStore, replaced

ROWS = "id long, name string, run int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def upsert(old, new):
    return stores.upsert_first_wins(old, new, "id", ("run",))


def made(spark, tmp_path, n=200, buckets=8):
    return KeyedStore.create(str(tmp_path / "store"), rows(spark, *[(k, f"n{k}", 0) for k in range(n)]), ["id"], buckets)


def held(store, version=None):
    return {r.id: (r.name, r.run) for r in store.read(version).collect()}


def same_bucket(store, spark, key, same=True):
    """A key that shares the bucket of key, or does not."""
    said = store.manifest()
    number = {r.id: r.b for r in spark.range(200).select("id", store.bucket(["id"], said["buckets"]).alias("b")).collect()}
    return next(k for k in sorted(number) if k != key and (number[k] == number[key]) == same)


def test_a_merge_reads_and_writes_one_bucket(spark, tmp_path):
    store = made(spark, tmp_path)
    before = store.manifest()["files"]
    assert len(before) == 8 and sum(f["rows"] for f in before) == 200
    done = store.merge(rows(spark, (5, "other", 1)), upsert)
    after = store.manifest()["files"]
    assert len(done.buckets) == len(done.read) == len(done.written) == 1
    assert set(done.read) == {f["file"] for f in before} - {f["file"] for f in after} and len(after) == 8
    assert held(store) == {k: (f"n{k}", int(k == 5)) for k in range(200)} and held(store, 0)[5] == ("n5", 0)
    own = {p for f in store.lookup(5).inputFiles() for p in [f.split("/store/")[1]]}
    assert own == set(done.written) and [tuple(r) for r in store.lookup(5).collect()] == [(5, "n5", 1)]
    near = {r.id for r in store.touched_by(spark.createDataFrame([(5,)], "id int")).collect()}  # keys of another type
    assert 5 in near and len(near) == next(f["rows"] for f in after if f["file"] in done.written)


@pytest.mark.parametrize("same", [True, False])
def test_the_second_writer_loses_nothing(spark, tmp_path, same):
    store, other = made(spark, tmp_path), KeyedStore(spark, str(tmp_path / "store"))
    rival, calls = same_bucket(store, spark, 7, same), []

    def slow(old, new):
        calls.append(1)
        if len(calls) == 1:  # another writer commits in between
            assert other.merge(rows(spark, (rival, "rival", 2), (rival + 1000, "new", 2)), upsert).version == 1
        return upsert(old, new)

    done = store.merge(rows(spark, (7, "x", 3), (5000, "late", 3)), slow)
    overlap = set(done.buckets) & set(f["bucket"] for f in store.manifest(1)["files"] if f not in store.manifest(0)["files"])
    assert done.version == 2 and done.retries == 1 and len(calls) == (2 if overlap else 1) and (overlap or not same)
    now = held(store)
    assert now[7] == ("n7", 3) and now[rival] == (f"n{rival}", 2) and now[rival + 1000] == ("new", 2) and now[5000] == ("late", 3) and len(now) == 202


def test_only_one_of_two_commits_a_version(spark, tmp_path):
    store = made(spark, tmp_path)
    said = store.manifest()
    assert store._commit(1, said) and not store._commit(1, {**said, "files": []})
    assert store.versions() == [0, 1] and len(held(store)) == 200
    with pytest.raises(FileExistsError):
        made(spark, tmp_path)
    assert len(held(store)) == 200


def test_a_batch_counts_once(spark, tmp_path):
    store = KeyedStore.create(str(tmp_path / "seen"), spark.createDataFrame([], "dedup_hash string, first_seen timestamp, last_seen timestamp, times_seen long"), ["dedup_hash"], 4)
    mark = lambda old, new: stores.mark_seen(old, new, F.lit("2024-01-01").cast("timestamp"))
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "dedup_hash string")
    assert store.merge(batch, mark, "run", 0) and store.merge(batch, mark, "run", 0) is None
    assert store.merge(batch.limit(0), mark, "run", 1).buckets == () and store.merge(batch, mark, "run", 1) is None
    assert {r.dedup_hash: r.times_seen for r in store.read().collect()} == {"a": 2, "b": 1}
    assert store.merge(batch, mark, "again", 0) and {r.dedup_hash: r.times_seen for r in store.read().collect()} == {"a": 4, "b": 2}


def test_versions_are_pinned_and_dropped(spark, tmp_path):
    store = made(spark, tmp_path, 20, 2)
    pinned = store.read()
    store.merge(rows(spark, (1, "one", 1)), lambda old, new: replaced(old, new, ["id"]))
    store.merge(rows(spark, (2, "gone", 1)), lambda old, new: old.join(new, "id", "left_anti"))
    assert pinned.count() == 20 and held(store, 1)[1] == ("one", 1) and 2 not in held(store) and 2 in held(store, 1)
    gone = store.vacuum(1)
    assert gone and store.versions() == [2] and len(held(store)) == 19 and held(store)[1] == ("one", 1)


def test_rows_of_other_buckets_are_refused(spark, tmp_path):
    store = made(spark, tmp_path)
    far = same_bucket(store, spark, 7, False)
    with pytest.raises(ValueError, match="buckets"):
        store.merge(rows(spark, (7, "x", 3)), lambda old, new: old.unionByName(rows(spark, (far, "astray", 1))))
    assert store.versions() == [0] and len(held(store)) == 200


def test_odd_keys(spark, tmp_path):
    store = KeyedStore.create(str(tmp_path / "odd"), spark.createDataFrame([(None, "a b", 1), ("x'y", None, 2)], "k string, l string, n int"), ["k", "l"], 3)
    store.merge(spark.createDataFrame([("x'y", None, 5), ("é", "=/", 6)], "k string, l string, n int"), lambda old, new: old.unionByName(new).groupBy("k", "l").agg(F.max("n").alias("n")))
    assert sorted((str(r.k), str(r.l), r.n) for r in store.read().collect()) == [("None", "a b", 1), ("x'y", "None", 5), ("é", "=/", 6)]
    assert [r.n for r in store.lookup(("é", "=/")).collect()] == [6]
