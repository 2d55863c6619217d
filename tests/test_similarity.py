import random

import numpy as np

from tidemark.operators import similarity
from tidemark.plans import records


def brute(rows, least=0.8):
    def bag(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    bags = {k: bag(t) for k, t in rows}
    texts = dict(rows)
    root = {k: k for k, _ in rows}
    for _ in rows:
        for a in root:
            for b in root:
                if (texts[a] or "") == (texts[b] or "") or (bags[a] & bags[b] and len(bags[a] & bags[b]) / len(bags[a] | bags[b]) >= least):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[k]] == root[k] for k in root):
            break
    return root


def test_three_signals_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        kind = rng.randrange(4)
        if kind and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = f"x{k}"
            text = " ".join(w)
        else:
            text = rng.choice([None, "", "a b", " ".join(f"w{rng.randrange(40)}" for _ in range(70))])
        rows.append((k, text))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.first for r in similarity.three_signals(df, "id", "text").collect()}
    assert got == brute(rows)
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (5, [0.99, 0.01], 1), (9, [0.0, 1.0], 1)], "key long, vector array<double>, bucket int")
    tied = {r.id: r.first for r in similarity.three_signals(df, "id", "text", vectors).collect()}
    assert tied[5] == tied[0] == 0


def test_vectors_of_unlike_buckets_are_compared(spark):
    df = spark.createDataFrame([(k, f"text number {k}") for k in (0, 5, 9)], "id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (5, [0.99, 0.01], 2), (9, [0.0, 1.0], 1)], "key long, vector array<double>, bucket int")
    got = {r.id: r.first for r in similarity.three_signals(df, "id", "text", vectors).collect()}
    assert got == {0: 0, 5: 0, 9: 9}


def test_all_cosine_pairs_equal_brute_force_over_several_blocks(spark):
    rng = random.Random(3)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(3)]) for k in range(1200)]
    size = lambda v: sum(x * x for x in v)
    want = {(a, b) for a, va in rows for b, vb in rows if a < b and size(va) * size(vb) > 0 and sum(x * y for x, y in zip(va, vb)) / (size(va) * size(vb)) ** 0.5 >= 0.97}
    odd = [(None, [1.0, 0.0, 0.0]), (1200, None), (1201, [1.0, None, 0.0]), (1202, [1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "key long, vector array<double>")
    got = [(r.a, r.b) for r in similarity.all_cosine_pairs(df, "key", "vector", 0.97).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert similarity.all_cosine_pairs(df.limit(0), "key", "vector", 0.97).collect() == []


def test_turns_of_a_long_conversation_keep_their_own_classes(spark):
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(12))
    rows = [(1, n, text(n)) for n in range(1100)] + [(2, 0, text(7)), (2, 1, text(2000)), (10, 0, text(1000)), (10, 1, None)]
    got = {r.id: r.first for r in records.turn_classes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if k != v} == {"2:0": "1:7", "10:0": "1:1000"}


def test_document_classes_equal_brute_force_over_all_three_signals(spark, sf_dir):
    docs, vectors = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "embeddings"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    v = {r.vec_id: [float(x) for x in r.embedding] for r in vectors.collect() if r.vec_id in texts}
    bags = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for k, t in texts.items()}
    size = {k: sum(x * x for x in u) for k, u in v.items()}

    def tied(a, b):
        both = len(bags[a] & bags[b])
        if texts[a] == texts[b] or (both and both >= 0.8 * (len(bags[a]) + len(bags[b]) - both)):
            return True
        return a in v and b in v and sum(x * y for x, y in zip(v[a], v[b])) >= 0.4 * (size[a] * size[b]) ** 0.5

    want = {k: k for k in texts}
    for a in sorted(texts):
        for b in (k for k in texts if k > a):
            if want[a] != want[b] and tied(a, b):
                low, high = sorted((want[a], want[b]))
                want = {k: low if r == high else r for k, r in want.items()}
    got = {r.doc_id: r.first for r in records.vector_classes(docs, vectors, 0.4).collect()}
    assert got == want
    assert len(set(want.values())) < len(set(texts.values()))  # more than equal texts are tied


def test_near_links_equal_all_pairs_where_a_third_are_near_copies(spark):
    rng = random.Random(21)
    base, passage = [f"b{n}" for n in range(60)], [f"p{n}" for n in range(40)]
    rows = []
    for k in range(240):
        kind = k % 3
        if kind == 0:  # near copies of one text
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(60)] = f"x{k}"
        elif kind == 1:  # a passage that many share, with words of their own
            w = passage + [f"y{k}x{n}" for n in range(rng.randrange(0, 60))]
        else:
            w = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 30))]
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.first for r in similarity.three_signals(df, "id", "text").collect()}
    assert got == brute(rows)


def test_near_links_of_odd_texts(spark):
    rows = [(0, None), (1, ""), (2, "  "), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, " ".join("abcdefghij") + " k")]
    df = spark.createDataFrame(rows, "id long, text string")
    links = {(r.a, r.b) for r in similarity.near_links(df, "id", "text").collect()}
    assert (3, 4) in links and (6, 7) in links and all(a in (3, 6, 7) for a, _ in links)
    assert similarity.near_links(df.limit(0), "id", "text").collect() == []


def test_near_links_hold_the_edge_of_the_similarity(spark):
    words = [f"w{n}" for n in range(13)]  # nine shingles, then one more each: 9 / 10, 9 / 11, 9 / 12
    rows = [(0, " ".join(words)), (1, " ".join([*words, "x"])), (2, " ".join(["y", "z", *words])), (3, " ".join([*words, "q", "r", "s"]))]
    df = spark.createDataFrame(rows, "id long, text string")
    want = {(a, b) for a, ta in rows for b, tb in rows if a < b and (lambda x, y: 10 * len(x & y) >= 9 * len(x | y))({tuple(ta.split()[i : i + 5]) for i in range(len(ta.split()) - 4)}, {tuple(tb.split()[i : i + 5]) for i in range(len(tb.split()) - 4)})}
    got = {(r.a, r.b) for r in similarity.near_links(df, "id", "text", 0.9).collect()}
    assert want == {(0, 1)} and got == want


def test_blocks_that_cannot_hold_a_near_pair_never_meet(spark):
    rng = random.Random(12)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(8)]
    rows = [(k, [c + rng.gauss(0, 0.08) for c in centres[k % 8]]) for k in range(800)] + [(800 + k, centres[0]) for k in range(300)]
    df = spark.createDataFrame(rows, "key long, vector array<double>")
    size = lambda v: sum(x * x for x in v) ** 0.5
    units = [(k, [x / size(v) for x in v]) for k, v in rows]
    want = {(a, b) for n, (a, u) in enumerate(units) for b, v in units[n + 1 :] if sum(x * y for x, y in zip(u, v)) >= 0.99}
    blocks, pairs = similarity.cosine_blocks(df, "key", "vector", 0.99, 64, 8)
    count = blocks.count()
    assert pairs.count() < count * (count + 1) / 2 / 3
    got = [(r.a, r.b) for r in similarity.all_cosine_pairs(df, "key", "vector", 0.99, 64).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_blocks_are_not_shuffled_for_their_pairs(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(900)], "key long, vector array<double>")
    plan = similarity.all_cosine_pairs(df, "key", "vector", 0.9, 64)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_only_texts_in_a_pair_are_held_whole(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(40))) for k in range(60)] + [(100 + k, " ".join([f"w{k}x{n}" for n in range(40)] + ["more"])) for k in range(3)]
    kept = {}
    write = similarity.write_table
    monkeypatch.setattr(similarity, "write_table", lambda df, tag: kept.setdefault(tag, []).append(write(df, tag)) or kept[tag][-1])
    monkeypatch.setattr(similarity, "drop_table", lambda *tables: None)
    rng.shuffle(rows)
    links = similarity.near_links(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {(r.a, r.b) for r in links} == {(k, 100 + k) for k in range(3)}
    assert sum(t.count() for t in kept["sets"]) == 6 and kept["prefixes"][0].count() < 6 * 40


def test_links_do_not_depend_on_which_shingles_are_told_as_common(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{n}" for n in range(30)]
    rows = [(k, " ".join(passage + [f"y{rng.randrange(12)}x{n}" for n in range(rng.randrange(0, 12))])) for k in range(160)]
    df = spark.createDataFrame(rows, "id long, text string")
    want = brute(rows)
    for seen in (1, 1000):
        monkeypatch.setattr(similarity, "SEEN", seen)
        assert {r.id: r.first for r in similarity.three_signals(df, "id", "text").collect()} == want


def kept_tables(monkeypatch):
    kept, write = {}, similarity.write_table
    monkeypatch.setattr(similarity, "write_table", lambda df, tag: kept.setdefault(tag, []).append(write(df, tag)) or kept[tag][-1])
    monkeypatch.setattr(similarity, "drop_table", lambda *tables: None)
    return kept


def test_words_and_shingles_are_those_of_plain_splitting_in_stretches_of_any_size(monkeypatch):
    rng, bits = random.Random(1), [b"a", b"b", b" ", b"\n", b"cc ", b"longword", b"\xc3\xa9", b"\x00", b"\x1c", b"a b c d e f g h "]
    for stretch in (5, 16, 1 << 16):
        monkeypatch.setattr(similarity, "STRETCH", stretch)
        monkeypatch.setattr(similarity, "_POWERS", similarity._powers(stretch))
        words, bags = {}, {}
        for _ in range(60):
            texts = [b"".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(rng.randrange(1, 6))]
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            hashes, until = similarity._word_hashes(data, ends)
            split = [t.split() for t in texts]
            assert np.diff(until, prepend=0).tolist() == [len(w) for w in split]
            assert all(words.setdefault(w, h) == h for w, h in zip((w for one in split for w in one), hashes.tolist(), strict=True))
            shingled, stop = similarity._shingled(data, ends)
            for w, h in zip(split, np.split(shingled, stop[:-1])):
                bag = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
                assert len(h) == len(bag) and bags.setdefault(bag, h.tolist()) == h.tolist()
        assert len(set(words.values())) == len(words) and len({tuple(h) for h in bags.values()}) == len(bags)


def test_equal_texts_and_equal_vectors_are_compared_once(spark, monkeypatch):
    kept = kept_tables(monkeypatch)
    rng = random.Random(2)
    texts = [" ".join(f"w{k}x{n}" for n in range(30)) for k in range(4)]
    df = spark.createDataFrame([(k, texts[k % 4]) for k in range(80)], "id long, text string")
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    near = spark.createDataFrame([(k, vectors[k % 3] if k < 60 else vectors[0][:5] + [vectors[0][5] + 0.001]) for k in range(80)], "key long, vector array<double>")
    got = {r.id: r.first for r in similarity.three_signals(df, "id", "text", near).collect()}
    assert set(got.values()) == {0}
    assert kept["first"][0].count() == 4 and kept["vectors"][1].count() == 4
    assert kept["tied"][0].count() < 80  # not the pairs


def test_pairs_of_a_block_become_a_forest_that_ties_the_same(spark):
    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(3)]) for k in range(700)]
    df = spark.createDataFrame(rows, "key long, vector array<double>")
    least = 0.995
    pairs = [(r.a, r.b) for r in similarity.all_cosine_pairs(df, "key", "vector", least, 128).collect()]
    links = [(r.a, r.b) for r in similarity.cosine_links(df, "key", "vector", least, 128).collect()]

    def roots(edges):
        root = list(range(700))
        while True:
            before = list(root)
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    assert roots(links) == roots(pairs) and len(links) < len(pairs)


def test_whole_sets_meet_only_where_outlines_leave_room(spark, monkeypatch):
    kept = kept_tables(monkeypatch)
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = [(k, " ".join(words("p", 60) + words(f"y{k}x", 40))) for k in range(12)] + [(100 + k, " ".join(words("z", 90) + words(f"q{k}", 2))) for k in range(2)]
    got = {(r.a, r.b) for r in similarity.near_links(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(100, 101)}
    assert sum(t.count() for t in kept["pairs"]) > 1 and {(r.a, r.b) for t in kept["kept"] for r in t.collect()} == {(100, 101)}
