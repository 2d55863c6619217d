import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import neardup
from tidemark.llm.common import components, table


def bag(text, width=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def exact(a, b):
    if not a or not b:
        return 0.0
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def brute(rows, threshold=0.8):
    rows = [(k, t or "") for k, t in rows if k is not None]
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    bags = [bag(t) for _, t in rows]
    for i, (k, t) in enumerate(rows):
        for j in range(i):
            small, large = sorted((sum(bags[i].values()), sum(bags[j].values())))
            if t == rows[j][1] or (bags[i].keys() & bags[j].keys() and exact(bags[i], bags[j]) >= threshold):
                a, b = sorted((find(k), find(rows[j][0])))
                parent[b] = a
    return {k: find(k) for k, _ in rows}


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "en", "é", "Sh", "a", "re"]) for _ in range(rng.randint(1, 5)))
    rows, hub = [], [word() for _ in range(80)]
    for k in range(n):
        kind = rng.randrange(6)
        if kind == 0 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 1 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 2:
            w = list(hub)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 3:
            text = ((" ".join(word() for _ in range(12))) + "\n") * rng.randint(1, 4)
        else:
            text = " ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 120])))
        rows.append((k * 13 % n, text))
    return rows


def test_similarity_equals_the_sum():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ((" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))) for _ in range(2))
        assert neardup.similarity(neardup.weighted(a), neardup.weighted(b)) == pytest.approx(exact(bag(a), bag(b)))


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(300)]
    for edits in (0, 6, 20):
        other = list(base)
        for _ in range(edits):
            other[rng.randrange(300)] = "x" + str(rng.random())
        a, b = " ".join(base), " ".join(other + base[:40])
        marks, has = neardup.signatures([a.encode(), b.encode()], 4096)
        assert has.all() and np.mean(marks[0] == marks[1]) == pytest.approx(exact(bag(a), bag(b)), abs=0.035)


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a is not None:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.duplicate) for r in neardup.classes(df).collect()}
    want = brute(rows)
    assert got == {k: (root, root != k) for k, root in want.items()}


def test_nulls_empty_repeated_and_clashing(spark):
    long = " ".join(map(str, range(30_000)))
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n"), (4, "a b c d e f"), (4, "a b c d e f"), (6, "A b c D e f"), (7, long), (8, long + " x"), (None, None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, id string, copy int")
    got = sorted((r.doc_id, r.class_id, r.duplicate) for r in neardup.classes(df).collect() if r.doc_id is not None)
    assert got == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 4, False), (4, 4, False), (6, 4, True), (7, 7, False), (8, 7, True)]
    assert [(r.class_id, r.duplicate) for r in neardup.classes(df).collect() if r.doc_id is None] == [(None, False)] * 2
    assert neardup.classes(df.limit(0)).collect() == []


def test_small_scale_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: r.class_id for r in neardup.op2_probminhash_dedup(spark, sf_dir).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [(256, 1024), (7, 11)])
def test_family_whose_copies_are_far_from_each_other(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for k in range(110):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((k * 7 % 110, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_the_query_equals_all_pairs_of_a_thousand_documents(spark):
    """Every pair of sf0.01 by the exact bound, then exactly: its classes, and so its links, are the query's."""
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    first = {}
    root = {k: first.setdefault(t, k) for k, t in docs}  # copies
    texts = [(k, neardup.weighted(t)) for t, k in first.items()]
    index = neardup.Shares([b for _, b in texts])

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, (k, bag) in enumerate(texts):
        most = index.bounds(bag) if len(bag[0]) else []
        for j in [j for j, m in enumerate(most) if j < n and m >= 0.8 - 1e-9]:
            if neardup.similarity(bag, texts[j][1]) >= 0.8 - 1e-12:
                a, b = find(k), find(texts[j][0])
                root[max(a, b)] = min(a, b)
    want = {k: find(k) for k, _ in docs}
    got = {r.doc_id: r.class_id for r in neardup.op2_probminhash_dedup(spark, sf).collect()}
    assert got == want and 10 < sum(k != c for k, c in want.items())
