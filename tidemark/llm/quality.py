"""Document quality by a linear-chain conditional random field over lines.

Every line that holds anything is a node, good or bad; its features are those of its own bytes and
words and those of the lines before and after it. Transition weights tie neighbours together.
Forward-backward gives each line's marginal probability of good, and a document's quality is their
mean, weighted by the lines' lengths.

The field is fitted by L-BFGS on the driver, on the `sample` labelled documents whose ids hash
lowest, of each at most `lines` lines in a row from a place its hash names: a bounded sample by two
documented parameters; scoring reads every line. A label marks a document and its lines take it, so no
change of label occurs in training: the transition weights learn how strongly a line speaks for its
neighbours, not where quality changes. Documents, labels and features of one Arrow batch are all that a
worker holds; the sample's features are all the driver holds.

Defined results: a null or empty text, or one of white space only, has no line and scores the share
of good documents in the sample; without labels of both kinds every document scores that share (0.5
without any); a null key is not held out. Several labels of one document count as the lowest; null labels are none. Equal texts
score alike. Language, source, label and key are no features, and no other column is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table
from tidemark.llm.words import prefix, spans, stretch_hash

SAMPLE, SAMPLE_LINES = 4000, 1000
RIDGE = 1e-3
_COMMON = np.zeros(256, np.uint8)
_COMMON[list(b".,;:'\"!?()-")] = 1
_DIGIT, _UPPER, _SYMBOL = (np.zeros(256, np.uint8) for _ in range(3))
_DIGIT[48:58] = 1
_UPPER[65:91] = 1
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 1
_HIGH = np.zeros(256, np.uint8)
_HIGH[128:] = 1
OWN = 17


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line with any content: its text's number, its bytes, and its own features."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    end = np.flatnonzero(data == 10)
    start = np.append(0, end[:-1] + 1)
    owner = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
    w0, w1 = spans(data)
    first, last = np.searchsorted(w0, start), np.searchsorted(w0, end)
    solid = last > first
    start, end, owner, first, last = (x[solid] for x in (start, end, owner, first, last))
    size, words = (end - start).astype(float), (last - first).astype(float)
    if not len(start):
        return owner, size, np.zeros((0, OWN), np.float32)

    def share(flags):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags[data], out=sums[1:], dtype=np.int32)
        return (sums[end] - sums[start]) / size

    def per_word(flags):
        sums = np.append(0, np.cumsum(flags))
        return (sums[last] - sums[first]) / words

    sums = prefix(data)
    h = stretch_hash(sums, w0, w1)
    line = np.repeat(np.arange(len(start)), last - first)
    order = np.lexsort((h, line))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(line[order]) != 0) | (h[order][1:] != h[order][:-1])
    unique = np.bincount(line[order][new], minlength=len(start))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    whole = stretch_hash(sums, start, end)
    echo = np.zeros(len(start))
    echo[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])
    length = w1 - w0
    symbols = share(_SYMBOL)
    final = data[end - 1]
    out = np.stack(
        [
            np.log1p(size) / 5,
            symbols,
            np.sqrt(symbols),
            share(_DIGIT),
            share(_UPPER),
            share(_COMMON),
            share(_HIGH),
            unique / words,
            np.log(unique) / np.log1p(words),
            per_word(again),
            np.sqrt(per_word(again)),
            per_word(_SYMBOL[data[w1 - 1]].astype(bool)),
            np.minimum(size / words, 40) / 10,
            per_word(length > 14),
            echo,
            np.isin(final, list(b".!?")).astype(float),
            (words < 2).astype(float),
        ],
        1,
    )
    return owner, size, out.astype(np.float32)


def with_neighbours(owner: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a text's ends), both ends' marks, and 1."""
    n = len(owner)
    out = np.zeros((n, 3 * OWN + 3), np.float32)
    out[:, :OWN] = own
    joined = owner[1:] == owner[:-1]
    out[1:, OWN : 2 * OWN] = own[:-1] * joined[:, None]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:] * joined[:, None]
    out[:, 3 * OWN] = 1
    out[1:, 3 * OWN] -= joined
    out[:, 3 * OWN + 1] = 1
    out[:-1, 3 * OWN + 1] -= joined
    out[:, 3 * OWN + 2] = 1
    return out


def _chains(owner: np.ndarray):
    """Positions of the lines by step along their chain: steps[t] are the t-th lines of all chains that have one."""
    lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    size = np.diff(np.append(lead, len(owner)))
    order = np.argsort(-size, kind="stable")
    lead, size = lead[order], size[order]
    return [lead[: np.searchsorted(-size, -t, "left")] + t for t in range(int(size[0]))] if len(size) else []


def forward_backward(steps: list, node: np.ndarray, tie: np.ndarray):
    """Log partition summed over chains, P(good) per line, and expected transitions. node: score of good per line; tie: 2 x 2."""
    n = len(node)
    score = np.zeros((n, 2))
    score[:, 1] = node
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    for t, at in enumerate(steps):
        if t == 0:
            up[at] = score[at]
        else:
            before = up[at - 1]
            up[at] = score[at] + np.logaddexp(before[:, :1] + tie[0], before[:, 1:] + tie[1])
    for at in reversed(steps[1:]):
        after = score[at] + down[at]
        down[at - 1] = np.logaddexp(after[:, :1] + tie[:, 0], after[:, 1:] + tie[:, 1])
    both = up + down
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    expected, log_z = np.zeros((2, 2)), 0.0
    if steps:
        log_z = float(total[steps[0]].sum())
        if len(steps) > 1:
            later = np.concatenate(steps[1:])
            pair = up[later - 1][:, :, None] + tie[None] + (score[later] + down[later])[:, None, :] - total[later][:, None, None]
            expected = np.exp(pair).sum(0)
    return log_z, good, expected


def minimise(f: Callable, x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    value, slope = f(x)
    past: list = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(kept)):
            q += s * (a - r * (y @ q))
        step, gain = (1.0 if past else min(1.0, 1 / (np.abs(slope).sum() + 1e-12))), slope @ q
        for _ in range(30):
            new = x - step * q
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * step * gain:
                break
            step /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        done = value - new_value < 1e-6 * max(1, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def fit(chains: list[tuple[np.ndarray, int]]) -> dict:
    """The model from (own features of a document's lines, label) pairs."""
    labels = np.array([y for _, y in chains], int)
    prior = float(labels.mean()) if len(labels) else 0.5
    chains = [(x, y) for x, y in chains if len(x)]
    if len({y for _, y in chains}) < 2:
        return {"prior": prior, "weights": None}
    owner = np.repeat(np.arange(len(chains)), [len(x) for x, _ in chains])
    x = with_neighbours(owner, np.concatenate([x for x, _ in chains])).astype(float)
    y = np.repeat([y for _, y in chains], [len(x) for x, _ in chains])
    mean, spread = x.mean(0), x.std(0)
    mean[-1], spread[spread < 1e-6] = 0, 1
    x = (x - mean) / spread
    steps = _chains(owner)
    same = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    k = x.shape[1]

    def loss(p):
        node, tie = x @ p[:k], p[k:].reshape(2, 2)
        log_z, good, expected = forward_backward(steps, node, tie)
        value = log_z - node @ y - (tie * seen).sum()
        slope = np.concatenate((x.T @ (good - y), (expected - seen).ravel()))
        return value / len(chains) + RIDGE * p @ p, slope / len(chains) + 2 * RIDGE * p

    p = minimise(loss, np.zeros(k + 4))
    return {"prior": prior, "weights": p[:k] / spread, "shift": -float((p[:k] / spread) @ mean), "tie": p[k:].reshape(2, 2)}


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    out = np.full(len(texts), model["prior"])
    if model["weights"] is None:
        return out
    owner, size, own = line_features(texts)
    node = with_neighbours(owner, own).astype(float) @ model["weights"] + model["shift"]
    _, good, _ = forward_backward(_chains(owner), node, model["tie"])
    total = np.bincount(owner, size, len(texts))
    has = total > 0
    out[has] = (np.bincount(owner, size * good, len(texts))[has] / total[has]).clip(0, 1)
    return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> dict:
    """Fit on at most `sample` labelled documents that are not held out, at most `lines` lines of each."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("key"))).groupBy("key").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(sample)  # bounded: the sample
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(known), "key")

    def run(batch):
        texts = [t.encode() for t in batch.column(2).to_pylist()]
        owner, _, own = line_features(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        rows = []
        for t, a, b in zip(texts, cuts[:-1], cuts[1:]):
            at = a + zlib.crc32(t) % (b - a - lines + 1) if b - a > lines else a
            rows.append(own[at : min(b, at + lines)].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["key", "label", "lines"])

    got = map_batches(rows.select("key", "label", "body"), run, f"key {rows.schema['key'].dataType.simpleString()}, label int, lines binary").collect()
    got.sort(key=lambda r: (r.key, r.lines))
    return fit([(np.frombuffer(r.lines, np.float32).reshape(-1, OWN), r.label) for r in got])


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "_score") -> DataFrame:
    """key, the columns to keep, and the score (probability-like, 1 is good) as column `name`, which none of them may have."""
    if name in (key, *keep):
        raise ValueError(f"a column {name} is there already")
    rows = docs.select(*[F.col(c) for c in dict.fromkeys((key, text, *keep))])
    names = rows.columns
    at = names.index(text)
    wanted = list(dict.fromkeys((key, *keep)))

    def run(batch):
        texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
        columns = [batch.column(names.index(c)) for c in wanted]
        return pa.RecordBatch.from_arrays([*columns, pa.array(score_texts(model, texts))], [*wanted, name])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in wanted) + f", `{name}` double"
    return map_batches(rows, run, schema)


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality_crf": op6_quality_crf}
ORACLES: dict[str, str] = {}
