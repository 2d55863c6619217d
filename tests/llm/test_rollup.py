import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import rollup
from tidemark.llm.common import table
from tidemark.llm.tokens import PATTERN, ranks

SCHEMA = "op string, doc_id long, tokenizer string, source string, lang string, tokens long, bytes long, seq long"


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens, x.bytes) for x in r.totals().collect()}


def replay(batches):
    state, seen = {}, set()
    for name, rows in batches:
        if name in seen:
            continue
        seen.add(name)
        last = {}
        for op, doc, tok, source, lang, n, b, seq in rows:
            if doc is not None:
                v = (seq, n, b, source, lang, op)
                if (doc, tok) not in last or v > last[doc, tok]:
                    last[doc, tok] = v
        for k, (_, n, b, source, lang, op) in last.items():
            if op == "insert" or (op == "revise" and k in state):
                state[k] = (source, lang, n, b)
            elif op == "delete":
                state.pop(k, None)
    out = defaultdict(lambda: [0, 0, 0])
    for (_, tok), (source, lang, n, b) in state.items():
        out[source, lang, tok] = [x + y for x, y in zip(out[source, lang, tok], (1, n, b))]
    return {k: tuple(v) for k, v in out.items()}


def test_equals_a_replay(spark, tmp_path):
    rng = random.Random(6)
    row = lambda: (rng.choice(["insert", "delete", "revise"]), rng.choice([None, *range(12)]), rng.choice("tu"), rng.choice("ab"), rng.choice("xy"), rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 3))
    batches = [(name, [row() for _ in range(25)]) for name in ("one", "two", "one", "three", "two", "four")]
    r = rollup.Rollup(spark, str(tmp_path))
    done = [r.apply(name, spark.createDataFrame(rows, SCHEMA)) for name, rows in batches]
    assert done == [True, True, False, True, False, True]
    assert totals(r) == replay(batches)
    again = rollup.Rollup(spark, str(tmp_path))
    assert set(again.batches()) == {"one", "two", "three", "four"} and totals(again) == totals(r)


def _insert(doc, n=3):
    return ("insert", doc, "t", "a", "x", n, n, 0)


def test_a_batch_reads_the_buckets_it_changes(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path), buckets=16)
    r.apply("load", spark.createDataFrame([_insert(k) for k in range(200)], SCHEMA))
    old = r.changed(spark.createDataFrame([(5,)], "doc_id long"))
    [scan] = re.findall(r"FileScan parquet .*", old._jdf.queryExecution().sparkPlan().toString())
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN \(\d+\)|= \d+)", scan)  # one of 16
    assert [x.doc_id for x in old.collect()] == [5]


def test_compaction_changes_no_result(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path), buckets=4)
    r.compact()
    r.apply("one", spark.createDataFrame([_insert(k) for k in range(9)], SCHEMA))
    r.apply("two", spark.createDataFrame([("delete", 3, "t", None, None, 0, 0, 0), ("revise", 4, "t", "b", "x", 7, 7, 0)], SCHEMA))
    before, counts = totals(r), sorted(r.counts().collect())
    r.compact()
    assert totals(r) == before and sorted(r.counts().collect()) == counts and r._folders()[0][0].startswith("base-") and len(r._folders()[0]) == 1
    assert not r.apply("one", spark.createDataFrame([_insert(50)], SCHEMA))
    r.apply("three", spark.createDataFrame([("delete", 4, "t", None, None, 0, 0, 0), _insert(3, 5)], SCHEMA))
    assert totals(r) == {("a", "x", "t"): (8, 7 * 3 + 5, 7 * 3 + 5)}
    assert totals(rollup.Rollup(spark, str(tmp_path), buckets=4)) == totals(r)


def test_a_writer_that_lost_its_claim_is_not_seen(spark, tmp_path, monkeypatch):
    """Two interleaved writers: one pauses between claim and rename, its claim is given away, and it wakes."""
    slow, fast = rollup.Rollup(spark, str(tmp_path)), rollup.Rollup(spark, str(tmp_path))
    one, two = (spark.createDataFrame([_insert(k)], SCHEMA) for k in (1, 2))
    monkeypatch.setattr(rollup, "STALE", -1)
    slow._write(f"{slow.path}/_work-{'a' * 32}", 1, one)
    assert slow._claim(1, "a" * 32)
    assert not fast._claim(1, "b" * 32) and fast.apply("fast", two)
    assert slow._fs.rename(slow._at(f"{slow.path}/_work-{'a' * 32}"), slow._at(f"{slow.path}/batch-00000001-{'a' * 32}-slow"))
    assert slow.batches() == fast.batches() == {"fast": 1} and totals(slow) == {("a", "x", "t"): (1, 3, 3)}
    assert slow.apply("slow", one) and totals(fast) == {("a", "x", "t"): (2, 6, 6)}


def test_nulls_and_a_failed_batch(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path))
    rows = [("insert", 1, "t", None, None, None, 4, 0), ("insert", 2, "t", None, None, 3, 4, 0), ("other", 3, "t", "a", "x", 1, 1, 0)]
    with pytest.raises(Exception):
        r.apply("bad", spark.createDataFrame(rows, SCHEMA).withColumn("tokens", spark.sql("select 1").sparkSession.createDataFrame([], "a int").a))
    assert r.apply("good", spark.createDataFrame(rows, SCHEMA)) and totals(r) == {(None, None, "t"): (2, 3, 8)}
    assert r.apply("none", spark.createDataFrame([], SCHEMA)) and len(totals(r)) == 1
    assert r.apply("gone", spark.createDataFrame([("delete", 1, "t", "z", "z", 9, 9, 0), ("delete", 2, "t", None, None, 0, 0, 0)], SCHEMA)) and totals(r) == {}
    with pytest.raises(ValueError):
        r.apply("a/b", spark.createDataFrame(rows, SCHEMA))


def test_documents_against_brute_force(spark, sf_dir):
    docs = [r for r in table(spark, sf_dir, "documents").collect()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    multi = tiktoken.Encoding("m", pat_str=PATTERN, mergeable_ranks=ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    count = {"byte_bpe_50k.json": lambda s: len(t.encode(s, add_special_tokens=False).ids), "byte_bpe_multi_50k.tiktoken": lambda s: len(multi.encode_ordinary(s))}
    first, want = {}, defaultdict(lambda: [0, 0, 0])
    for d in sorted(docs, key=lambda d: d.doc_id):
        first.setdefault(d.text, d.doc_id)
    for d in docs:
        if first[d.text] == d.doc_id:
            for name, f in count.items():
                tidy = rollup._tidy(d.text)
                want[d.source, d.lang, name] = [x + y for x, y in zip(want[d.source, d.lang, name], (1, f(tidy), len(tidy.encode())))]
    got = {(x.source, x.lang, x.tokenizer): [x.docs, x.tokens, x.bytes] for x in rollup.op8_token_rollup(spark, sf_dir).collect()}
    assert got == want
    assert any(rollup._tidy(d.text) != d.text for d in docs)  # the batch of revisions is not empty


def test_tidying_passes_over_a_text_only_where_there_is_something_to_tidy(monkeypatch):
    def plain(text):
        lines = re.sub(r" +(?=\n|$)", "", re.sub(r"[ \t]+", " ", text)).split("\n")
        return "\n".join(line for n, line in enumerate(lines) if not n or line != lines[n - 1])

    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab \t\n \r\u00a0") for _ in range(rng.randrange(12)))
        assert rollup._tidy(text) == plain(text)
    monkeypatch.setattr(rollup.re, "sub", None)
    assert rollup._tidy("one two\nthree\nthree") == "one two\nthree"
