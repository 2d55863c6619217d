import math
import random
from collections import Counter

import numpy as np

from tidemark.operators import skillvec
from tidemark.plans import profiles, serving
from tidemark.sources.binding import job_skills, jobs


def dense(rows):
    """The matrix by plain counting, and its skills in order."""
    sets: dict = {}
    for job, skill in rows:
        if job is not None and skill is not None:
            sets.setdefault(job, set()).add(skill)
    n, pair = Counter(s for x in sets.values() for s in x), Counter((a, b) for x in sets.values() for a in x for b in x)
    names = sorted(n)
    return names, np.array([[max(0.0, math.log(pair[a, b] * len(sets) / (n[a] * n[b]))) if pair[a, b] else 0.0 for b in names] for a in names])


def best(matrix, rank):
    values, turn = np.linalg.eigh(matrix)
    first = np.argsort(-np.abs(values), kind="stable")[:rank]
    return turn[:, first] * np.sqrt(np.abs(values[first]))


def rows_of(rng, jobs_=300):
    stacks = [[f"s{g}x{k}" for k in range(6)] for g in range(4)]
    out = [(j, rng.choice(stacks[j % 4] if rng.random() < 0.85 else stacks[rng.randrange(4)])) for j in range(jobs_) for _ in range(rng.randrange(1, 6))]
    return [*out, out[0], (None, "s0x0"), (3, None)]


def test_vectors_equal_the_exact_decomposition(spark):
    rows = rows_of(random.Random(3))
    names, matrix = dense(rows)
    table = skillvec.ppmi(spark.createDataFrame(rows, "job_id long, skill string"))
    assert {(r.a, r.b): round(r.x, 9) for r in table.collect()} == {(a, b): round(matrix[i, j], 9) for i, a in enumerate(names) for j, b in enumerate(names) if matrix[i, j] > 0}
    got = {r.skill: r.v for r in skillvec.vectors(table, 4, 8).collect()}
    found, want = np.array([got[n] for n in names]), best(matrix, 4)
    assert np.allclose(found @ found.T, want @ want.T, atol=1e-4)  # whatever the signs
    every = {r.skill: r.v for r in skillvec.vectors(table, 40).collect()}  # more than there are
    assert len(every[names[0]]) <= len(names)


def test_no_skills(spark):
    none = spark.createDataFrame([], "job_id long, skill string")
    assert skillvec.vectors(skillvec.ppmi(none)).collect() == []


def test_match_and_its_fallback(spark):
    rows = rows_of(random.Random(5))
    df = spark.createDataFrame(rows, "job_id long, skill string")
    known = skillvec.vectors(skillvec.ppmi(df), 4)
    people = spark.createDataFrame([(1, "s0x0"), (1, "s0x1"), (2, "s1x0"), (3, "nothing")], "id long, skill string")
    posts = df.filter("job_id % 4 = 0").select("job_id").distinct()
    got = {r.id: r for r in skillvec.market_match(people, posts, df, known, 4).collect()}
    assert got[1].match_pct > got[2].match_pct and got[1].strong > 0.5 and abs(got[1].strong + got[1].moderate + got[1].weak - 1) < 1e-3
    assert tuple(got[3])[1:] == skillvec.UNKNOWN
    few = skillvec.market_match(people, posts.limit(5), df, known, 4).collect()
    assert all(tuple(r)[1:] == skillvec.UNKNOWN for r in few)


def test_persons_of_the_same_skills_are_matched_once(spark, monkeypatch):
    rows = rows_of(random.Random(7))
    df = spark.createDataFrame(rows, "job_id long, skill string")
    known = skillvec.vectors(skillvec.ppmi(df), 4)
    people = spark.createDataFrame([(i, s) for i in range(200) for s in ("s0x0", f"s1x{i % 2}", "s0x0", None)] + [(None, "s0x0")], "id long, skill string")
    sizes, means = [], skillvec.means
    monkeypatch.setattr(skillvec, "means", lambda r, *more: (sizes.append(r.count()), means(r, *more))[1])
    got = {r.id: tuple(r)[1:] for r in skillvec.market_match(people, df.select("job_id").distinct(), df, known, 4).collect()}
    assert sizes[0] == 4  # two sets of two skills
    assert len(got) == 201 and len({got[i] for i in range(0, 200, 2)}) == 1 and got[0] != got[1] and got[None] == skillvec.UNKNOWN


def test_the_registered_match_equals_exact_vectors(spark, sf_dir):
    j, s = jobs(spark, sf_dir), job_skills(spark, sf_dir)
    year = {r.job_id for r in j.filter("scraped_at >= timestamp_ntz'1998-01-01' and scraped_at < timestamp_ntz'1999-01-01'").collect()}
    rows = [(r.job_id, r.skill) for r in s.select("job_id", "skill").collect()]
    names, matrix = dense([x for x in rows if x[0] in year])
    known = dict(zip(names, best(matrix, profiles.RANK)))
    own: dict = {}
    for job, skill in rows:
        own.setdefault(job, set()).add(skill)
    posts = [np.mean([known[k] for k in own[r.job_id] if k in known], 0) for r in serving.newest_sample(j, "data_scientist").collect() if any(k in known for k in own.get(r.job_id, ()))]
    got = {r.id: r for r in profiles.market_match_by_vectors(spark, sf_dir).collect()}
    for person in (1, 7, 50, 149):
        mine = np.mean([known[x] for x in {f"brand#{(person * a + b) % 25 + 1}" for a, b in ((1, 0), (3, 5), (7, 11))} if x in known], 0)
        near = [float(mine @ v / np.sqrt((mine @ mine) * (v @ v))) for v in posts]
        assert abs(got[person].match_pct - min(100, max(0, 100 * np.mean(near)))) < 0.2
        assert abs(got[person].strong - np.mean([x > 0.75 for x in near])) < 0.02
