import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality
from tidemark.llm.common import table


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    owner = np.array([0, 0, 0, 0, 1, 2, 2])
    node, tie = rng.normal(size=7), rng.normal(size=(2, 2))
    log_z, good, expected = quality.forward_backward(quality._chains(owner), node, tie)
    total_z, want_pairs, want = 0.0, np.zeros((2, 2)), np.zeros(7)
    for chain in range(3):
        at = np.flatnonzero(owner == chain)
        weights = {}
        for ys in itertools.product((0, 1), repeat=len(at)):
            weights[ys] = math.exp(sum(node[i] * y for i, y in zip(at, ys)) + sum(tie[a, b] for a, b in zip(ys, ys[1:])))
        z = sum(weights.values())
        total_z += math.log(z)
        for ys, w in weights.items():
            want[at] += np.array(ys) * w / z
            for a, b in zip(ys, ys[1:]):
                want_pairs[a, b] += w / z
    assert log_z == pytest.approx(total_z) and good == pytest.approx(want) and expected == pytest.approx(want_pairs)


def test_features_of_lines():
    owner, size, own = quality.line_features([b"A b b.\n\n12 $$", b"", b" \n", b"x"])
    assert owner.tolist() == [0, 0, 3] and size.tolist() == [6, 5, 1]
    assert own[0, 7] == pytest.approx(1.0)  # "b" and "b." differ
    assert own[1, 1] == pytest.approx(0.4) and own[1, 3] == pytest.approx(0.4)
    alone = quality.line_features([b"12 $$"])[2]
    assert np.allclose(alone[0], own[1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op6_quality_crf(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[k].score, y) for k, y in labels.items() if got[k].held_out]
    bad, good = [s for s, y in held if not y], [s for s, y in held if y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.95


def test_nulls_empty_tables_and_ties(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["river", "stone", "walks", "green", "over"]) for _ in range(9)) + "."
    rows = [(k, clean() if k % 2 else "%%% $$$ ### " * 5, "en") for k in range(60)] + [(100, None, "en"), (101, "", "en"), (102, " \n ", "en"), (None, "x", None), (103, "same\n" * 4000, "en"), (104, "same\n" * 4000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r._score for r in quality.score(docs, model).collect()}
    assert got[100] == got[101] == got[102] == model["prior"] and got[103] == got[104] and len(got) == len(rows)
    assert min(got[k] for k in range(60) if k % 2) > 0.5 > max(got[k] for k in range(60) if not k % 2)
    none = quality.train(docs, labels.limit(0))
    assert {r._score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []
