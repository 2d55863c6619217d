"""The posting domain bound to the driver tables: orders stand for postings, order lines for their skills.

Both are plain projections over joins, so filters and column pruning reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

#: The week that single-week queries look at, a Monday.
WEEK = "1998-06-01"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    role = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "ml_engineer")
        .when(F.col("o_orderpriority") == "2-HIGH", "data_scientist")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ai_engineer")
        .when(F.col("o_orderpriority") == "5-LOW", "other")
    )
    model = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "remote").when(F.col("c_mktsegment") == "BUILDING", "hybrid").otherwise("onsite")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderdate").alias("scraped_at"),
        F.col("c_name").alias("company"),
        F.lower("n_name").alias("location"),
        role.alias("role_category"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("salary_min"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 1.2).alias("salary_max"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("offers_sponsorship"),
        F.lower("c_mktsegment").alias("company_stage"),
        model.alias("work_model"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_startup"),
        F.concat(F.lit("src"), F.col("o_custkey") % 8).alias("source"),
    )


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_orderkey").alias("job_id"),
        F.lower("p_brand").alias("skill"),
        F.lower("p_type").alias("skill_category"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


#: The same views for the oracle.
CTE = """jobs AS (SELECT o_orderkey AS job_id, o_orderdate AS scraped_at, c_name AS company, lower(n_name) AS location,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'ml_engineer' WHEN '2-HIGH' THEN 'data_scientist' WHEN '3-MEDIUM' THEN 'ai_engineer' WHEN '5-LOW' THEN 'other' END AS role_category,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS salary_min, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * 1.2::DOUBLE END AS salary_max,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS offers_sponsorship, lower(c_mktsegment) AS company_stage,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'remote' WHEN 'BUILDING' THEN 'hybrid' ELSE 'onsite' END AS work_model, c_mktsegment = 'BUILDING' AS is_startup,
    'src' || (o_custkey % 8) AS source
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    job_skills AS (SELECT l_orderkey AS job_id, lower(p_brand) AS skill, lower(p_type) AS skill_category, 1 - l_discount AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey)"""
