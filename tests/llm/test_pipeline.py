import corpus_pipeline
from tidemark.llm import neardup, quality
from tidemark.llm.common import table, write_table
from tests.llm.test_suffixes import brute as brute_repeats


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = [docs]
    for _, stage in corpus_pipeline.STAGES:
        got.append(write_table(stage(spark, got[-1], sf_dir), "stage"))
    assert all(g.columns == docs.columns for g in got[1:4])
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r._score >= 0.5}
    assert {r.doc_id for r in got[1].collect()} == good and 0 < len(good) < docs.count()
    firsts = {r.doc_id for r in neardup.classes(got[1]).collect() if not r.duplicate}
    assert {r.doc_id for r in got[2].collect()} == firsts
    before = {r.doc_id: r.text for r in got[2].collect()}
    removed = brute_repeats([(k, t.encode()) for k, t in before.items()], 100)
    for r in got[3].collect():
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (removed[r.doc_id][1] == 0)
        assert len(r.text.encode()) <= removed[r.doc_id][0] - removed[r.doc_id][1]
    assert {r.doc_id for r in got[4].collect()} == firsts
    assert corpus_pipeline.run(spark, sf_dir).count() == got[4].count()


def test_odd_rows_pass_every_stage(spark, sf_dir):
    rows = [(None, "one two three four five six.", "en", None, 3, "x"), (2, None, None, "s", None, "x"), (3, "", "en", "s", 0, "x"), (3, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score string")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, d, sf_dir)
            assert out.columns == d.columns and out.count() <= d.count()
        assert corpus_pipeline.pack(spark, d, sf_dir).count() == d.count()


def test_clashing_names(spark, sf_dir):
    names = ["_score", "score", "key", "row", "block", "body", "tie", "keep0", "kept", "spans", "id", "copy", "label", "length", "ids"]
    docs = spark.createDataFrame([(k, "one two three four five six. " * k, *names) for k in range(1, 5)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns and all(list(r)[2:] == names for r in now.collect())
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() == 4
