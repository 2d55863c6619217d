import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.sources import landing


def land(root, kind, board, day, name, data):
    folder = root / f"kind={kind}" / f"board={board}" / f"date={day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)


def filled(tmp_path):
    root = tmp_path / "landed"
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        land(root, "greenhouse", "acme", day, "a.json", json.dumps({"jobs": [{"id": day}]}).encode())
        land(root, "lever", "b%20co", day, "b.json", b"[]")
    land(root, "cv", "x", "2024-01-02", "c.pdf", b"%PDF\x00\xff")
    (root / "_started").write_bytes(b"x")
    return root


def opened(df):
    """How many files the plan's scan took in: its tasks read groups of one file here."""
    return df.rdd.getNumPartitions()


def test_filters_decide_which_files_are_opened(spark, tmp_path):
    root = str(filled(tmp_path))
    every = landing.files(spark, root, group_bytes=1)
    assert sorted({(r.kind, r.board, str(r.date)) for r in every.collect()})[0] == ("cv", "x", "2024-01-02")
    assert every.count() == 7 and opened(every) == 7
    some = landing.files(spark, root, group_bytes=1).filter((F.col("board") == "acme") & (F.col("date") >= F.lit(dt.date(2024, 1, 2))))
    assert sorted(str(r.date) for r in some.collect()) == ["2024-01-02", "2024-01-03"] and opened(some) == 2
    assert [bytes(r.content) for r in landing.files(spark, root).filter("kind = 'cv'").collect()] == [b"%PDF\x00\xff"]
    assert {r.board for r in landing.files(spark, root).filter("board in ('b co', 'none')").collect()} == {"b co"}
    assert landing.files(spark, root).filter("kind <> 'lever' and length(content) > 6").count() == 3
    assert opened(landing.files(spark, root)) == 1  # small files share a task


def test_columns_without_content_open_nothing(spark, tmp_path):
    root = filled(tmp_path)
    listed = landing.files(spark, str(root), columns="kind,board,size")
    assert listed.columns == ["kind", "board", "size"] and listed.agg(F.sum("size")).first()[0] > 20
    reading = landing._Reading(str(root), ["kind", "size"], 1 << 20)
    for f in root.rglob("*.json"):
        f.unlink()  # gone, so opening one would fail
    parts = landing.Files([(f"{root}/none.json", {"kind": "x", "size": 3})])
    assert list(reading.rows(parts)) == [("x", 3)]


def test_no_files(spark, tmp_path):
    assert landing.files(spark, str(tmp_path / "none")).collect() == []


def test_a_restarted_stream_repeats_nothing(spark, tmp_path):
    root, out, check = filled(tmp_path), str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        query = landing.stream(spark, str(root), columns="kind,file,date").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        query.awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 7
    assert run() == 7
    land(root, "lever", "late", "2024-01-04", "d.json", b"[]")
    assert run() == 8
    assert spark.read.parquet(out).filter("file = 'd.json'").count() == 1
