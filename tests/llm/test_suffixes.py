import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffixes
from tidemark.llm.common import table


def brute(rows, n):
    """[(key, bytes)] -> {key: (n_bytes, n_removed, n_spans, sha)}; keys distinct."""
    seen, out = set(), {}
    for key, body in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        gone = [False] * len(body)
        for i in range(len(body) - n + 1):
            w = body[i : i + n]
            if w in seen:
                gone[i : i + n] = [True] * n
            seen.add(w)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[key] = (len(body), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(body, gone) if not g)).hexdigest())
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffixes.remove_repeats(df, **more).collect()
    return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "en", "é", "sh", "a", "re"]) for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    common, short, line = text(60), text(9)[:70], text(22)
    rows = []
    for k in range(n):
        kind = rng.randrange(8)
        body = text(rng.randint(0, 150))
        if kind == 0 and rows:
            body = rng.choice(rows)[1] or ""
        elif kind == 1:
            body = text(20) + common + text(20)
        elif kind in (2, 3):
            body = text(20) + " " + short + " " + text(20)
        elif kind == 4:
            body = "ab" * rng.randint(0, 300)
        elif kind == 5:
            body = (line + "\n") * rng.randint(1, 5) + text(5)
        elif kind == 6 and rows:
            old = rng.choice(rows)[1] or ""
            cut = rng.randint(0, len(old))
            body = old[:cut] + "x" + old[cut:]
        rows.append((k * 7 % n, body))
    return rows


@pytest.mark.parametrize("hot,block,several", [(1000, 1 << 20, 8000), (3, 1 << 20, 8000), (1000, 3000, 5), (3, 3000, 1)])
def test_equals_brute_force(spark, hot, block, several):
    rows = corpus(hot)
    assert got(spark, rows, hot=hot, block_bytes=block, sorted_=several) == brute([(k, t.encode()) for k, t in rows], 100)


def test_the_query_equals_brute_force(spark, sf_dir):
    texts = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf_dir, "documents").collect()]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op10_suffix_dedup(spark, sf_dir).collect()}
    assert out == brute(texts, 100) and sum(r[1] for r in out.values()) > 0


def test_highly_repetitive_texts(spark):
    """Versions of one text, each with a few edits of the last: nearly all of it repeats."""
    rng = random.Random(9)
    now, rows = "".join(rng.choice("acgt") for _ in range(3000)), []
    for k in range(25):
        rows.append((k, now))
        for _ in range(2):
            at = rng.randrange(len(now))
            now = now[:at] + rng.choice(["", "a", "ct", now[at : at + 150]]) + now[at + rng.randint(0, 3) :]
    want = brute([(k, t.encode()) for k, t in rows], 100)
    assert got(spark, rows) == want == got(spark, rows, hot=2, sorted_=50)
    assert sum(r[1] for r in want.values()) > 0.7 * sum(r[0] for r in want.values())


@pytest.mark.parametrize("width", [3, 8, 20, 100])
def test_suffix_ranks_order_by_letters(width):
    rng = random.Random(width)
    data = bytes(rng.choice(b"ab\x00\xff") for _ in range(400)) + b"ab" * 200
    at = np.array(sorted(rng.sample(range(len(data) - width), 300)))
    rank = suffixes.suffix_ranks(np.frombuffer(data, np.uint8), width, at)
    words = [data[i : i + width] for i in at]
    order = {w: n for n, w in enumerate(sorted(set(words)))}
    assert rank.tolist() == [order[w] for w in words]


def test_long_texts_cross_blocks(spark):
    rng = random.Random(1)
    part = "".join(rng.choice("abcdef ") for _ in range(150_000))
    rows = [(1, part + part[:90_000] + part), (2, "z" + part), (3, "short")]
    assert got(spark, rows) == brute([(k, t.encode()) for k, t in rows], 100)


def test_nulls_empty_and_clashing_columns(spark):
    same = "x1" * 80
    rows = [(None, same), (4, None), (5, ""), (6, same + "tail")]
    found = got(spark, rows)
    assert found == brute([(k, (t or "").encode()) for k, t in rows], 100)
    wide = spark.createDataFrame([(1, "a", 2, b"k", 3)], "doc_id long, text string, row long, body binary, key int")
    assert suffixes.remove_repeats(wide).collect()[0].kept == b"a"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(none).collect() == []


def test_rows_of_one_key_do_not_repeat_each_other(spark):
    body = "".join(chr(97 + i * 7 % 26) for i in range(300)) + "q" * 3
    df = spark.createDataFrame([(1, body), (1, body), (2, body)], "doc_id long, text string")
    out = suffixes.remove_repeats(df).collect()
    kept = sorted(r.n_bytes - len(r.kept) for r in out)
    assert kept[-1] == len(body) and kept[0] == kept[1]
