import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg


def brute(rows, wanted):
    clean = sorted({(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, label, a in clean:
        if not wanted(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, m) for j, m, b in clean if j != i)
        for s, pid, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, pid, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fit)]
    return sorted(out)


def got(spark, rows, wanted, **more):
    df = hardneg.labelled(spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, label long, embedding array<double>, v string"), F.col("label"))
    return sorted(map(tuple, hardneg.mine(df, df.filter(wanted), **more).collect()))


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"block": 7, "chunk": 5, "tasks": 9})])
def test_equals_brute_force(spark, seed, more):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    rows = []
    for i in range(400):
        label = rng.choice([0, 0, 1, 2, 3])
        v = centres[0] if rng.random() < 0.3 else [c + rng.gauss(0, 0.7) for c in centres[rng.randrange(4)]]
        rows.append((i, label, v))
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and got(spark, rows, "id % 10 = 0", **more) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, None), (2, 1, [nan]), (3, 2, [inf]), (4, None, [1.0]), (5, 1, [1.0, 2.0]), (5, 1, [1.0, 2.0]), (6, 2, [1.0]), (7, 2, []), (None, 2, [1.0, 1.0]), (8, 3, [0.3, 0.5, 4.0]), (9, 1, [-1.0, 0.0]), (10, 1, [0.0])]
    want = brute(rows, lambda i: True)
    assert want and got(spark, rows, "true", tasks=3) == want
    assert got(spark, rows[1:4], "true") == [] and got(spark, rows[:1], "true") == [] and got(spark, rows, "false") == []


def test_scores_fit_or_are_refused(spark):
    with pytest.raises(OverflowError, match="64 bits"):
        got(spark, [(0, 1, [1e9]), (1, 1, [1e9])], "true")


def test_bounds_discard_most_pairs_and_lose_none():
    rng = np.random.default_rng(5)
    scale = 2.0 ** -np.arange(32)
    v = np.floor(4000 * rng.normal(size=(600, 32)) * scale @ np.linalg.qr(rng.normal(size=(32, 32)))[0]).astype(np.int64)
    basis = hardneg.basis_of(v)
    turned = hardneg.Turned(v, basis)
    ids, labels = np.arange(600), rng.integers(0, 3, 600)
    mine = hardneg.Turned(v[:20], basis)
    wanted = hardneg.Wanted(ids[:20], labels[:20], mine, np.arange(20), np.full(20, -hardneg.FAR), np.full(20, hardneg.FAR), 5, False)
    for s in range(0, 600, 100):
        wanted.meet(ids[s : s + 100], labels[s : s + 100], hardneg.Turned(v[s : s + 100], basis))
    assert wanted.scored < wanted.seen / 3
    scores = v[:20] @ v.T
    for n in range(20):
        fit = [j for j in np.lexsort((ids, -scores[n])) if labels[j] != labels[n] and j != n][:5]
        assert [int(x) for x in wanted.kept[2][wanted.kept[0] == n]] == fit
    assert np.allclose(turned.x @ turned.x.T, v @ v.T)
