import random

import pytest

from tidemark.operators.clustered import Clustered


def made(spark, tmp_path, n=1200):
    rng = random.Random(7)
    rows = [(k, rng.randrange(60), rng.choice(["a", "a", "a", "b", None]), rng.random() < 0.3) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, at int, role string, visa boolean")
    return Clustered.write(str(tmp_path / "c"), df, [("at", True), ("id", False)], ["role", "visa"], 12), rows


def want(rows, number, size, **values):
    kept = sorted((r for r in rows if all(r[{"role": 2, "visa": 3}[c]] == v for c, v in values.items())), key=lambda r: (-r[1], r[0]))
    return [r[0] for r in kept[(number - 1) * size : number * size]], len(kept)


def test_pages_equal_the_sorted_table_and_open_two_files(spark, tmp_path):
    store, rows = made(spark, tmp_path)
    for number, size, values in ((1, 20, {}), (7, 100, {}), (60, 20, {}), (61, 20, {}), (3, 20, {"role": "a"}), (5, 50, {"role": "a", "visa": False}), (2, 30, {"visa": True}), (1, 20, {"role": "none"})):
        page = store.page(number, size, **values)
        got = page.collect()
        ids, total = want(rows, number, size, **values)
        assert [r.id for r in got] == ids and all((r.total, r.pages) == (total, max(1, -(-total // size))) for r in got)
        opened = {f.split("_file=")[1].split("/")[0] for f in page.inputFiles()} if got else set()
        assert len(opened) <= len(store.located(number, size, **values)[1]) <= (2 if not values else 12)
    assert len(store.located(60, 20)[1]) <= 2


def test_bounds(spark, tmp_path):
    store, _ = made(spark, tmp_path, 30)
    for number, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            store.page(number, size)
    with pytest.raises(ValueError, match="filtered"):
        store.page(1, 20, colour="red")


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id long, at int, role string")
    store = Clustered.write(str(tmp_path / "c"), df, [("at", True), ("id", False)], ["role"], 3)
    assert store.page(1, 20).collect() == [] and store.located(1, 20) == (0, [])
