from pyspark.sql import functions as F

from tidemark.plans import extraction, profiles
from tidemark.sources import landing


def test_cv_files_of_one_partition_are_dealt_to_tasks_and_read_once(spark, monkeypatch):
    k = F.col("id")
    files = spark.range(1, 60).coalesce(1).select("id", F.concat(F.lit("%PDF-1.4\nstream\nBT\n(Skills) Tj\n(Brand#"), (k % 3 + 1).cast("string"), F.lit(") Tj\nET\nendstream")).cast("binary").alias("content"))
    demand = spark.createDataFrame([(1, "brand#1", 1.0, 1.0, 1.0), (2, "brand#2", 0.5, 1.0, 1.0)], "rank int, skill string, demand double, salary double, recency double")
    tasks, write = {}, profiles.write_table

    def told(df, tag):
        tasks[tag] = df.rdd.getNumPartitions()
        return write(df, tag)

    monkeypatch.setattr(profiles, "write_table", told)
    out = profiles.analyse(files, demand, profiles.BRANDS)
    assert tasks["texts"] == profiles.DEALT * spark.sparkContext.defaultParallelism
    assert "parse_cv" not in out._jdf.queryExecution().optimizedPlan().toString()  # only the written texts are read again
    assert {r.id: r.skills for r in out.collect()} == {n: [f"brand#{n % 3 + 1}"] for n in range(1, 60)}


def test_a_board_of_many_postings_lands_in_files_of_bounded_size(spark, sf_dir):
    path = extraction._landed(spark, sf_dir, 40)
    system, lines, where = landing._system(path)[0], 0, set()
    for row, file, _ in landing.listed(path):
        with system.open_input_stream(file) as stream:
            held = stream.read().count(b"\n")
        assert held <= 40
        lines += held
        where.add((row["kind"], row["board"]))
    assert lines == extraction._postings(spark, sf_dir).count()
    assert ("ashby", "x") in where and len(where) == extraction._postings(spark, sf_dir).select(F.when(F.col("job_id") % 3 == 2, "x").otherwise(F.concat((F.col("job_id") % 3).cast("string"), "company"))).distinct().count()
