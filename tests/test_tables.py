import os
import subprocess
import sys
import textwrap

from tidemark.tables import drop_table, shared_dir, write_table


def test_tables_are_written_read_and_dropped(spark):
    made = write_table(spark.range(5).toDF("n"), "some")
    assert sorted(r.n for r in made.collect()) == list(range(5)) and shared_dir(spark) in made._shared_path
    drop_table(made)
    local = made._shared_path.removeprefix("file:")
    assert not os.path.exists(local)


def test_without_a_setting(tmp_path):
    """A plain session without spark.checkpoint.dir works, and leaves nothing behind."""
    code = """
        from pyspark.sql import SparkSession
        from tidemark.tables import shared_dir, write_table
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        assert write_table(spark.range(3).toDF("n"), "t").count() == 3
        print("folder", shared_dir(spark))
        spark.stop()
    """
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    folder = [line for line in done.stdout.splitlines() if line.startswith("folder ")][0].split()[1].removeprefix("file:")
    assert not os.path.exists(folder)
