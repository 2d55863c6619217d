import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import gru, lm
from tidemark.llm.common import table


def documents(rng, count, symbols):
    return [np.append(rng.integers(1, symbols, size=int(n)), gru.END).astype(np.uint16) for n in rng.integers(0, 60, size=count)]


def shaken(symbols=23, hidden=5, size=4, kind=np.float64):
    model = gru.Model(np.arange(symbols, 0, -1), hidden, size)
    rng = np.random.default_rng(3)
    for name in model.NAMES:
        value = getattr(model, name).astype(kind)
        setattr(model, name, value + rng.normal(size=value.shape).astype(kind) * 0.5)
    return model


def plain(model, doc):
    """The model's definition, one symbol at a time."""
    s = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    h, last, total, size = np.zeros(model.hidden), gru.END, 0.0, model.hidden
    for symbol in doc:
        x, a = model.x[last].astype(float), h @ model.u.astype(float)
        z, r = s(x[:size] + a[:size]), s(x[size : 2 * size] + a[size : 2 * size])
        h = (1 - z) * np.tanh(x[2 * size :] + r * a[2 * size :]) + z * h
        classes = soft(h @ model.c + model.c0)
        inner = [soft(model.w[k] @ h + model.w0[k]) for k in range(model.classes)]
        every = np.concatenate([p * q for p, q in zip(classes, inner)])
        assert abs(every.sum() - 1) < 1e-6
        total += math.log10(every[symbol])
        last = symbol
    return total


@pytest.mark.parametrize("lanes,steps", [(1, 7), (4, 16), (64, 5)])
def test_scores_carry_the_state_through_whole_documents(lanes, steps):
    model, docs = shaken(), documents(np.random.default_rng(1), 30, 23)
    found = model.score(docs, lanes, steps)
    assert np.allclose(found, [plain(model, d) for d in docs], rtol=1e-4, atol=1e-4)


def test_gradients_against_differences():
    model, docs = shaken(), documents(np.random.default_rng(2), 9, 23)
    window = next(gru.Lanes(docs, 4).windows(12))
    h = np.random.default_rng(4).normal(size=(5, window[0].shape[1])) * 0.3
    _, grads, _ = model.gradients(window, h)
    dense = np.zeros_like(model.x)
    dense[grads["x"][0]] = grads["x"][1]
    grads["x"] = dense
    rng = np.random.default_rng(5)
    for name in model.NAMES:
        value = getattr(model, name)
        spots = np.flatnonzero(np.isfinite(value.ravel()))
        for at in rng.choice(spots, size=min(12, len(spots)), replace=False):
            spot = np.unravel_index(at, value.shape)
            old, sides = value[spot], []
            for step in (1e-5, -1e-5):
                value[spot] = old + step
                sides.append(model.gradients(window, h)[0])
            value[spot] = old
            assert abs((sides[1] - sides[0]) / 2e-5 - grads[name][spot]) < 1e-4, name


def test_long_documents_are_laid_out_together(monkeypatch):
    monkeypatch.setattr(lm, "TOKENS", 4096)
    monkeypatch.setattr(lm, "LANES", 64)  # a lane's share is 64 tokens
    docs = [np.full(1000 if n % 40 == 3 else 20, n, np.uint16) for n in range(800)]
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(range(at, at + 100)), pa.array([d.tobytes() for d in docs[at : at + 100]], pa.binary())], ["row", "ids"])
    out = [(np.concatenate([p.column(0).to_numpy() for p in parts]), found) for parts, found in lm._laid(map(batch, range(0, 800, 100)), 1)]
    assert sorted(np.concatenate([r for r, _ in out])) == list(range(800))
    assert all(len(r) == len(found) and all((d == docs[k]).all() and len(d) == len(docs[k]) for k, d in zip(r, found)) for r, found in out)
    steps = sum(int(gru.Lanes(found, 64).size[0]) for _, found in out)
    assert steps < 5000  # the 20 long documents fill four lay-outs of 1000 steps; with a long one in every lay-out there were nine


@pytest.mark.parametrize("far", [80.0, 0.0])
def test_scores_by_blocks_and_with_far_logits(monkeypatch, far):
    monkeypatch.setattr(gru, "BLOCK", 7)
    monkeypatch.setattr(gru, "FAR", far)
    model, docs = shaken(), documents(np.random.default_rng(9), 30, 23)
    assert np.allclose(model.score(docs, 8, 16), [plain(model, d) for d in docs], rtol=1e-4, atol=1e-4)
    model.c[:, 0] *= 1000  # exp of these logits is nothing or infinite
    assert np.isfinite(model.score(docs, 8, 16)).all()


def test_learns_what_frequencies_do_not_tell():
    rng = np.random.default_rng(6)
    docs = [np.append((np.arange(n) + rng.integers(0, 5)) % 5 + 2, gru.END).astype(np.uint16) for n in rng.integers(20, 60, size=200)]
    model = gru.Model(np.bincount(np.concatenate(docs), minlength=12), 8, 4)
    before, memory = model.score(docs, 32, 16).sum(), {}
    for _ in range(8):
        model.learn(docs, 32, 16, 0.2, memory)
    assert model.score(docs, 32, 16).sum() > 0.5 * before


def brute(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score as the contract has them."""
    def tokens(t):
        return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w] + [None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for h, (_, t) in zip(held, rows) if not h for w in tokens(t))
    total, number = sum(c.values()), len(c)
    out = []
    for h, (i, t) in zip(held, rows):
        base = sum(math.log10((c[w] + 1) / (total + number + 1)) for w in tokens(t))
        out.append((i, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, round(base, 6)))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, word int")
    found = lm.score_documents(df, **more).collect()
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in found)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str)


def test_counts_and_base_scores(spark):
    rng = np.random.default_rng(8)
    names = [f"W{n}" for n in range(40)] + ["É", "été", "x" * 100, "X" * 100, " ", "end"]
    rows = [(int(i), " ".join(rng.choice(names, size=int(rng.integers(0, 30))))) for i in range(60)]
    rows += [(None, "W1 w1"), (7, None), (8, ""), (9, " \t\n"), (10, "a\x1cb a\x0bb A\x0cb\rc"), (11, "new words " * 3), (11, "new words " * 3), (16, "q " * 5000)]
    want = brute(rows)
    assert any(r[1] for r in want)
    assert got(spark, rows) == want
    assert got(spark, rows, hot=5, symbols=4) == want  # most words meet their counts in the join


def test_nothing_to_learn_from(spark):
    rows = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert rows and got(spark, rows) == brute(rows) and all(r[-1] == 0 for r in got(spark, rows[:1]))
    assert got(spark, []) == []


def test_model_beats_the_counts_on_held_out_documents(spark):
    found = [r for r in lm.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
