from tidemark.sources import schemas


def test_every_table_is_well_formed(spark):
    assert len(schemas.TABLES) == 21
    for name, table in schemas.TABLES.items():
        columns = schemas.empty(spark, name).columns
        assert {*table.key, *table.required, *table.defaults} <= set(columns) and table.partition in (None, *columns)


def test_conform_and_validate(spark):
    raw = spark.createDataFrame([("1", "h", "r", "t", "c", "s", "series_e"), ("1", None, "r", "t", "c", "s", "nothing")], "job_id string, dedup_hash string, run_id string, title string, company string, source string, company_stage string")
    rows = schemas.conform(raw, "jobs")
    first = rows.filter("dedup_hash = 'h'").first()
    assert (first.company_stage, first.salary_currency, first.is_startup, first.offers_sponsorship) == ("series_d_plus", "GBP", False, None)
    assert {(r.rule, r.rows) for r in schemas.validate(rows, "jobs").collect()} == {("dedup_hash missing", 1), ("company_stage outside its values", 1), ("key not unique", 1)}
    assert schemas.validate(schemas.empty(spark, "jobs"), "jobs").collect() == []
