from tidemark import catalog
from tidemark.sources.binding import jobs


def test_newest_of_role_takes_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    own = {r.job_id for r in jobs(spark, sf).filter("role_category = 'data_scientist'").select("job_id").collect()}
    got = [r.job_id for r in catalog.QUERIES["newest_of_role"](spark, sf).collect()]
    assert len(own) > 300 and len(got) == len(set(got)) == 300 and set(got) <= own
