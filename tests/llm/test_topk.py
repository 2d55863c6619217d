import math
import random

import pytest

from tidemark.llm import topk


def brute(rows, wanted, k):
    clean = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = {}
    for q, a in clean:
        if wanted(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def got(spark, rows, wanted, k, **more):
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"), "vec_id", "embedding")
    out = {}
    for r in sorted(topk.search(df.filter(wanted), df, k, **more).collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.id, r.score))
    return out


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 7)])
def test_equals_brute_force(spark, seed, block):
    rng = random.Random(seed)
    same = [rng.gauss(0, 1) for _ in range(6)]
    rows = []
    for i in range(260):
        v = same if rng.random() < 0.3 else [rng.gauss(0, 1) * rng.choice([0.1, 1, 3]) for _ in range(6)]
        rows.append((i, v, "z"))
    found = got(spark, rows, "id % 10 = 0", 5, pivots=6, annuli=3, block=block)
    assert found == brute([r[:2] for r in rows], lambda q: q % 10 == 0, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0]), (7, []), (None, [9.0, 9.0]), (8, [-1.0, 0.5, 4.0])]
    rows = [(*r, "z") for r in rows]
    found = got(spark, rows, "true", 2, pivots=2)
    assert found == brute([r[:2] for r in rows], lambda q: True, 2)
    assert got(spark, rows[1:2], "true", 2) == {} and got(spark, rows[:1], "true", 2) == {}


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [float(3**19 + i), float(i)], "z") for i in range(6)]
    assert got(spark, [(i, [x / 256 for x in v], z) for i, v, z in rows], "true", 3) == brute([(i, [x / 256 for x in v]) for i, v, _ in rows], lambda q: True, 3)
    with pytest.raises(Exception, match="64 bits"):
        got(spark, [(i, [1e12 + i], "z") for i in range(3)], "true", 1)
