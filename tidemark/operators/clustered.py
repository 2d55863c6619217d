"""Pages of a large table without sorting it for each: rows lie in files in the order that pages have, and counts tell where a page is.

Files are cut by range of the order and sorted within, and numbered along it. Beside them lies a small table of how many rows of
each file have which values of the columns that pages may be filtered by. A page adds these counts up along the files, and opens
those in which it begins and ends.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.tables import shared_dir


class Clustered:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.text(f"{self.path}/layout.json", wholetext=True).first()
        said = json.loads(row["value"])
        self.order, self.filters = [(c, down) for c, down in said["order"]], said["filters"]
        self.schema = StructType.fromJson(json.loads(said["schema"]))

    @classmethod
    def write(cls, path: str, rows: DataFrame, order: list[tuple[str, bool]], filters: list[str], files: int) -> Clustered:
        """rows in about `files` files along order (columns, each with whether it descends; the last ones break all ties) and their counts by filters."""
        path, spark = path.rstrip("/"), rows.sparkSession
        by = cls._by(order)
        rows.repartitionByRange(files, *by).sortWithinPartitions(*by).withColumn("_file", F.spark_partition_id()).write.partitionBy("_file").parquet(f"{path}/rows")
        spark.read.schema(StructType([*rows.schema.fields, StructField("_file", IntegerType())])).parquet(f"{path}/rows").groupBy("_file", *filters).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout.json")
        out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, False)
        out.write(bytearray(json.dumps({"order": order, "filters": filters, "schema": rows.schema.json()}), "utf-8"))
        out.close()
        return cls(spark, path)

    @classmethod
    def temporary(cls, rows: DataFrame, order: list[tuple[str, bool]], filters: list[str], files: int) -> Clustered:
        """In the application's folder, which goes when the application ends."""
        return cls.write(f"{shared_dir(rows.sparkSession)}/clustered-{uuid.uuid4().hex}", rows, order, filters, files)

    @staticmethod
    def _by(order) -> list[Column]:
        return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]

    def _where(self, values: dict) -> Column:
        if not set(values) <= set(self.filters):
            raise ValueError(f"pages are filtered by {', '.join(self.filters)}")
        out = F.lit(True)
        for c, v in values.items():
            out = out & (F.col(c) == F.lit(v))
        return out

    def located(self, number: int, size: int, **values) -> tuple[int, list[tuple[int, int]]]:
        """Rows in all that have the values, and the files of a page with how many of its rows lie in files before each."""
        if not 1 <= size <= 100 or number < 1:
            raise ValueError("a page holds 1 to 100 rows and pages count from 1")
        start = (number - 1) * size
        held = self.spark.read.parquet(f"{self.path}/counts").filter(self._where(values)).groupBy("_file").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, 0))  # a row a file
        known = held.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        total = known.agg(F.max("upto")).first()[0] or 0
        return total, [(r["_file"], r.before) for r in known.filter((F.col("upto") > start) & (F.col("before") < start + size)).orderBy("_file").collect()]  # at most `size` files

    def page(self, number: int = 1, size: int = 20, **values) -> DataFrame:
        """The page's rows, with total and pages. None of a page beyond the last."""
        total, files = self.located(number, size, **values)
        parts = [f"{self.path}/rows/_file={f}" for f, _ in files]
        rows = (self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)).filter(self._where(values))
        skip = (number - 1) * size - (files[0][1] if files else 0)
        cut = rows.orderBy(*self._by(self.order)).offset(skip).limit(size) if files else rows
        return cut.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(max(1, -(-total // size)))})
