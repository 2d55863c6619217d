import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens
from tidemark.llm.common import table
from tidemark.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def slow():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_the_library(slow, spark, sf_dir):
    enc = Encoder(PATH)
    texts = [r.text for r in table(spark, sf_dir, "documents").limit(80).collect()]
    rng = random.Random(3)
    odd = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "x\n\ny", "it's don't 's", "a\tb", "é ñ z", "　x y", "a\x1cb c", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext|>", " <|endoftext|>  \n<|endoftext", "1 2,3  4 .", "日本 語", "a b c", "​ x"]
    odd += ["".join(rng.choice(" \n\tabé'1.,  ") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for t in [*texts, *odd]:
        assert np.frombuffer(enc.encode(t, t.encode()), "<u4").tolist() == slow(t), repr(t[:80])


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 2048])
    counts = defaultdict(int)
    for _ in range(rng.choice([0, 1, 5, 50, 700, 4000])):
        counts[rng.randint(1, capacity) if rng.random() < 0.8 else capacity // 3] += rng.choice([1, 1, 1, 40])
    for scheme in packing.SCHEMES:
        classes = packing.plan(counts, capacity, *scheme)
        have = defaultdict(int)
        for filled, many in classes:
            assert sum(n * c for n, c in filled) <= capacity
            for n, c in filled:
                have[n] += c * many
        assert dict(have) == {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    least = max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
    used = sum(m for _, m in packing.best_plan(counts, capacity))
    assert used <= least * 1.06 + 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_grouping_equals_best_fit_decreasing_at_least(sf):
    enc, counts = Encoder(PATH), defaultdict(int)
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet").column("text").to_pylist():
        n = len(enc.encode(text or "", (text or "").encode())) // 4 + 1
        counts[2048] += (n - 1) // 2048
        counts[(n - 1) % 2048 + 1] += 1
    used = lambda *scheme: sum(m for _, m in packing.plan(counts, 2048, *scheme))
    plain = used(1.0, 1)  # nothing is grouped
    assert min(used(*s) for s in packing.SCHEMES) <= plain and used(*packing.SCHEMES[0]) <= plain


def test_a_special_string_is_one_id(spark, slow):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 40)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=16).collect()
    check(out, dict(rows), slow, 16)
    assert sum(r.length for r in out if r.doc_id == 1) == 5


def check(rows, texts, slow, capacity):
    ids = {k: [*slow(t or ""), 0] for k, t in texts.items()}
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(by_doc) == set(ids)
    for k, got in by_doc.items():
        at = 0
        for number, (piece, start, n) in enumerate(sorted(got)):
            assert (piece, start) == (number, at) and (number == 0 or n == capacity)
            at += n
        assert at == len(ids[k]) and (len(got) == 1) == (at <= capacity)
    return len(by_sequence)


def test_documents_round_trip(spark, sf_dir, slow):
    rows = packing.op7_best_fit_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    used = check(rows, texts, slow, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.03 + 1


def test_nulls_ties_and_clashing_columns(spark, slow):
    rows = [(k, t, 1, 2) for k, t in enumerate([None, "", "same text", "same text", "word " * 90, "x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, key int")
    out = packing.pack(df, capacity=16, keep_ids=True).collect()
    check(out, {r[0]: r[1] for r in rows}, slow, 16)
    assert all(len(r.ids) == 4 * r.length for r in out)
    assert packing.pack(df.limit(0)).collect() == []
    twice = packing.pack(df.union(df), capacity=16).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 2 * len(out)


def test_an_encoder_that_forgets_encodes_alike(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "γάμμα", "x" * 500, f"w{rng.randrange(400)}"]) for _ in range(200)) for _ in range(20)]
    whole = tokens.Encoder(path)
    want = [whole.encode(t, t.encode()) for t in texts]
    for most in (0, 900, 5000, 40_000):
        monkeypatch.setattr(tokens, "REMEMBERED", most)
        small = tokens.Encoder(path)
        assert [small.encode(t, t.encode()) for t in texts] == want
        assert small._inner.held <= most and sum(tokens.ENTRY for _ in small._inner) <= most
