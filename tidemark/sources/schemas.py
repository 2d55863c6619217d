"""The market namespace: tables with their types, keys, required columns and defaults, and one-pass validation.

Surrogate numbers are dropped for natural keys; JSON becomes maps, arrays and structs; tri-state flags stay nullable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vocabulary import ROLES, STAGES


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    partition: str | None = None


_PAY = "salary_p10 double, salary_p25 double, salary_p50 double, salary_p75 double, salary_p90 double"
TABLES: dict[str, Table] = {
    "jobs": Table(
        "job_id string, dedup_hash string, run_id string, title string, description string, company string, location string, salary_min double, salary_max double, salary_currency string, work_model string, "
        "experience_level string, role_category string, industry string, company_stage string, is_startup boolean, offers_sponsorship boolean, citizens_only boolean, degree_required string, equity_offered boolean, "
        "url string, source string, posted_date date, scraped_at timestamp, is_uk_headquartered boolean, employee_count_band string, sponsorship_signals array<string>, flexible_hours boolean, salary_midpoint double",
        ("job_id",), ("job_id", "dedup_hash", "run_id", "title", "company", "source"),
        {"salary_currency": "GBP", "work_model": "unknown", "company_stage": "unknown", "is_startup": False, "degree_required": "not_stated"},
    ),
    "job_skills": Table("job_id string, skill string, skill_category string, extraction_method string, confidence double, extracted_at timestamp", (), ("job_id", "skill"), {"extraction_method": "gate1", "confidence": 1.0}),
    "skill_taxonomy": Table("canonical string, aliases array<string>, category string, parent_skill string, created_at timestamp, updated_at timestamp", ("canonical",), ("canonical",)),
    "companies": Table("name string, stage string, sector string, employee_count_band string, founded_year int, hq_city string, is_uk_headquartered boolean, careers_url string, last_enriched_at timestamp", ("name",), ("name",)),
    "weekly_snapshots": Table(
        f"week_start date, role_category string, top_skills array<struct<r:int,skill:string,n:bigint>>, rising_skills array<string>, declining_skills array<string>, {_PAY}, salary_sample_size bigint, job_count bigint, "
        "skill_mentions bigint, new_job_count bigint, sponsorship_rate double, remote_rate double, hybrid_rate double, startup_rate double, top_cities array<struct<place:string,n:bigint>>, computed_at timestamp",
        ("week_start", "role_category"), ("week_start", "role_category"), {"role_category": "all", "job_count": 0}, "week_start",
    ),
    "skill_cooccurrence": Table("skill_a string, skill_b string, pmi_score double, co_count bigint, week date", ("skill_a", "skill_b", "week"), ("skill_a", "skill_b", "pmi_score", "co_count", "week"), {}, "week"),
    "ml_features": Table("job_id string, features map<string,double>, feature_version string, computed_at timestamp", ("job_id",), ("job_id", "features", "feature_version")),
    "model_evaluations": Table("model_name string, version string, metric_name string, metric_value double, eval_set_hash string, run_ref string, evaluated_at timestamp", (), ("model_name", "version", "metric_name", "metric_value")),
    "research_signals": Table("technique_name string, source string, first_seen date, mention_count int, first_in_jd date, adoption_lag_days int, relevance_score double, arxiv_ids array<string>, summary string, updated_at timestamp", ("technique_name",), ("technique_name", "source", "first_seen"), {"mention_count": 1, "relevance_score": 0.0}),
    "paper_index": Table("arxiv_id string, title string, techniques array<string>, relevance_score double, published_at date, indexed_at timestamp", ("arxiv_id",), ("arxiv_id", "title")),
    "pipeline_runs": Table("run_id string, dag_name string, started_at timestamp, completed_at timestamp, status string, jobs_scraped int, jobs_new int, jobs_deduplicated int, jobs_enriched int, llm_cost_usd double, sources_used array<string>, errors array<map<string,string>>, metadata map<string,string>", ("run_id",), ("run_id", "dag_name", "started_at"), {"status": "running"}),
    "agent_state": Table("agent_id string, department string, last_run_at timestamp, last_yield int, consecutive_failures int, run_count int, adaptive_params string, reflection_log array<string>, updated_at timestamp", ("agent_id",), ("agent_id", "department"), {"last_yield": 0, "consecutive_failures": 0, "run_count": 0, "adaptive_params": "{}"}),
    "agent_logs": Table("run_id string, agent_name string, department string, action string, input_summary string, output_summary string, duration_ms int, logged_at timestamp", (), ("agent_name", "department", "action")),
    "cost_log": Table("run_id string, agent_name string, model string, input_tokens int, output_tokens int, cost_usd double, logged_at timestamp", (), ("agent_name", "model", "input_tokens", "output_tokens", "cost_usd")),
    "qa_log": Table("run_id string, check_name string, result string, details map<string,string>, logged_at timestamp", (), ("check_name", "result")),
    "security_log": Table("event_type string, severity string, source_ip string, input_hash string, detection_method string, action_taken string, threat_score double, logged_at timestamp", (), ("event_type", "severity")),
    "alert_log": Table("alert_id string, severity int, department string, message string, dispatched_at timestamp, acknowledged_at timestamp", ("alert_id",), ("alert_id", "severity", "message")),
    "seen_jobs": Table("dedup_hash string, job_id string, title string, company string, source string, first_seen timestamp, last_seen timestamp, times_seen bigint", ("dedup_hash",), ("dedup_hash",), {"times_seen": 1}),
    "llm_cache": Table("cache_key string, result_json string, cached_at timestamp, expires_at timestamp", ("cache_key",), ("cache_key", "result_json", "expires_at")),
    "salary_history": Table(f"week_start date, role_category string, location string, {_PAY}, salary_mean double, sample_size bigint, computed_at timestamp", ("week_start", "role_category", "location"), ("week_start", "role_category", "location"), {"role_category": "all", "location": "UK"}, "week_start"),
    "skill_trends": Table("week_start date, skill string, job_count bigint, pct_of_jobs double, role_category string, computed_at timestamp", ("week_start", "skill", "role_category"), ("week_start", "skill", "role_category"), {"role_category": "all"}, "week_start"),
}

#: Allowed values by column; company stages outside the list that name a later series count as series_d_plus.
DOMAINS = {"role_category": (*ROLES, "all"), "company_stage": STAGES, "work_model": ("remote", "hybrid", "onsite", "unknown"), "experience_level": ("junior", "mid", "senior", "lead", "principal", "unknown")}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].ddl)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in its types: missing ones null (additive evolution), defaults filled in, stages mapped."""
    table, schema = TABLES[name], empty(df.sparkSession, name).schema
    columns = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in table.defaults:
            c = F.coalesce(c, F.lit(table.defaults[f.name]).cast(f.dataType))
        if f.name == "company_stage":
            c = F.when(c.rlike("^series_[e-z]$"), "series_d_plus").otherwise(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def validate(df: DataFrame, name: str) -> DataFrame:
    """Per rule (required columns, domains, unique key) how many rows break it, rules that hold left out."""
    table = TABLES[name]
    rules = [(f"{c} missing", F.col(c).isNull()) for c in table.required]
    rules += [(f"{c} outside its values", ~F.col(c).isin(*allowed)) for c, allowed in DOMAINS.items() if c in df.columns]
    one = df.agg(*[F.count_if(cond).alias(f"r{k}") for k, (_, cond) in enumerate(rules)])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{k}").alias("rows")) for k, (n, _) in enumerate(rules)])).alias("x")).select("x.*")
    if table.key:
        twice = df.groupBy(*table.key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit("key not unique").alias("rule"), "rows")
        out = out.unionByName(twice)
    return out.filter(F.col("rows") > 0)
