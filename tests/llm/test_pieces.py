import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(pieces.Vocabulary(PATH))


def every(v, text):
    """All segmentations of a text with their log probabilities, by brute force."""
    log = {}
    for node in range(len(v.piece_at)):
        if v.piece_at[node] >= 0:
            log[v.bytes_of[v.piece_at[node]].decode()] = (int(v.piece_at[node]), float(v.log_at[node]))

    def go(at):
        if at == len(text):
            yield (), 0.0
            return
        found = False
        for end in range(at + 1, min(len(text), at + 20) + 1):
            if text[at:end] in log:
                found |= end == at + 1
                i, p = log[text[at:end]]
                for ids, q in go(end):
                    yield (i, *ids), p + q
        if not found:
            raw = text[at].encode()
            for ids, q in go(at + 1):
                yield (*(int(v.byte_id[b]) for b in raw), *ids), q + len(raw) * v.byte_log

    rows = list(go(0))
    z = math.log(sum(math.exp(p) for _, p in rows))
    return {ids: p - z for ids, p in rows}


@pytest.mark.parametrize("text", ["ab", "the\nhe", "a  b", "éЖx"])
def test_probabilities_and_exhaustion(lattice, text):
    want = every(lattice.v, " " + text)
    k = len(want) + 3
    rows = pieces.sample(lattice, [text], np.array([5], np.uint64), k)[0]
    got = {tuple(ids.tolist()): p for ids, p, _, _ in rows}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    assert all(score == 0.0 for *_, score in rows)
    values = [g for _, _, g, _ in rows]
    assert values == sorted(values, reverse=True)


def test_draws_follow_sampling_without_replacement(lattice):
    want = every(lattice.v, " ab")
    n = 6000
    out = pieces.sample(lattice, ["ab"] * n, np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2)
    first = Counter(tuple(r[0][0].tolist()) for r in out)
    pairs = Counter(tuple(tuple(x[0].tolist()) for x in r) for r in out)
    p = {i: math.exp(q) for i, q in want.items()}
    for i, q in p.items():
        assert first[i] / n == pytest.approx(q, abs=4 * math.sqrt(q * (1 - q) / n) + 1e-3)
    for a, b in itertools.permutations(p, 2):
        q = p[a] * p[b] / (1 - p[a])
        assert pairs[a, b] / n == pytest.approx(q, abs=4 * math.sqrt(q * (1 - q) / n) + 1e-3)
    # Inclusion scores weight draws without bias: the sum of p / inclusion has mean 1.
    total = np.mean([sum(math.exp(x[1] - x[3]) for x in r) for r in out])
    assert total == pytest.approx(1, abs=0.03)


def test_documents_decode_and_are_distinct(spark, sf_dir, lattice):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.op5_gumbel_segmentations(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    by_doc = Counter((r.doc_id, r.ids_crc32) for r in rows)
    assert max(by_doc.values()) == 1 and len(rows) == 2 * len(texts)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in pieces.encode(docs.limit(20)).collect():
        assert library.decode(r.ids) == texts[r.doc_id].replace("▁", " ")


def test_samples_do_not_depend_on_neighbours(spark):
    rows = [(1, "one two  three\n\nfour"), (2, None), (3, ""), (None, " a▁b \u0000 \U0001f600"), (5, "x" * 3000), (5, "x" * 3000), (7, "tab\tq")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, seed int")
    got = pieces.decode(pieces.encode(df, k=3)).collect()
    alone = [x for r in range(len(rows)) for x in pieces.decode(pieces.encode(df.limit(r + 1).offset(r), k=3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, alone))
    texts = dict(rows)
    assert all(r.decoded == (texts[r.doc_id] or "") for r in got)
    assert [r.n_ids for r in got if r.doc_id in (2, 3)] == [0, 0]
    assert pieces.encode(df.limit(0)).collect() == []
