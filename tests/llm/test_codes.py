import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import codes


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain loops over (vec_id, vector, label), as the contract is written."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    size = max(1, -(-width // parts))
    kept = [(i, v + [0] * (size * parts - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), n) for n, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found: dict = {}
            for _, v, _ in kept:
                found.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*found[n])] if n in found else book for n, book in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best), label))
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == label), digest) for i, c, e, label in out), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    return sorted(map(tuple, codes.compress(df).collect()), key=str)


def test_equals_plain_loops(spark, monkeypatch):
    rng = random.Random(3)
    same = [np.float32(rng.gauss(0, 1)).item() for _ in range(8)]
    rows = []
    for i in range(300):
        v = same if rng.random() < 0.3 else [np.float32(rng.gauss(0, 1)).item() for _ in range(8)]
        rows.append((i * 7 % 300, v, rng.choice([None, 1, 1, 1, 2])))
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:40]) == brute(rows[:40])  # fewer rows than entries


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, -0.5], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], None), (4, [None, 1.0], 2), (5, [1.0] * 9, None), (5, [1.0] * 9, None), (5, [-1.0] * 9, 2), (None, [0.25], None), (8, [], 2)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[1:3]) == [] and got(spark, rows[:1]) == brute(rows[:1])
    assert got(spark, [(1, [], None)]) == brute([(1, [], None)])


def test_codes_stand_for_near_vectors(spark):
    books = np.array([[[0, 0], [10, 10]], [[5, 5], [9, 9]]])
    found, errors = codes.nearest(np.array([[1, 1, 9, 8], [10, 9, 7, 7]]), books)
    assert found.tolist() == [[0, 1], [1, 0]] and errors.tolist() == [[2, 1], [1, 8]]  # the last is as far from both: the first
    assert codes.decode("0001", books).tolist() == [0, 0, 9, 9]


def test_distances_fit_or_are_refused(spark):
    with pytest.raises(OverflowError, match="64 bits"):
        got(spark, [(0, [3e9], 1)])
