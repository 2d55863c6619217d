import random

import regex
from pyspark.sql import functions as F

from tidemark.functions import skills
from tidemark.functions.vocabulary import SKILLS
from tidemark.plans import extraction


def grams(text, taxonomy, most=5):
    """Every stretch of up to `most` words against the aliases."""
    clean = lambda x: [regex.sub(r"[./-]+$", "", w) for w in regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}+#./-]*", x.lower())]
    words, out = clean(text or ""), {}
    for name, category, aliases in taxonomy:
        for alias in {name.lower(), *aliases}:
            a = clean(alias)
            if any(words[k : k + len(a)] == a for k in range(len(words))):
                out[name, category] = max(out.get((name, category), 0), 1.0 if alias == name.lower() else 0.9)
    return out


def test_the_automaton_equals_all_word_stretches(spark):
    rng = random.Random(5)
    pool = [a for n, _, x in SKILLS for a in (n, *x)] + ["and", "the", "Lake", "delta", "torch-like", "spark", "sql.", "C++,", "(go)", "weights &", "biases", "ümlaut", "r", "R&D", "\n", "ci/cd/", "é"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for k in range(400)] + [(400, None), (401, ""), (402, "PyTorch" * 3)]
    got: dict = {}
    for r in skills.extract(spark.createDataFrame(rows, "k long, x string"), "k", "x").collect():
        got.setdefault(r.k, {})[r.skill, r.skill_category] = r.confidence
    assert got == {k: g for k, x in rows if (g := grams(x, SKILLS))}
    assert skills.extract(spark.createDataFrame([], "k long, x string"), "k", "x").collect() == []


def test_longest_matches_hide_what_is_inside_them(spark):
    df = spark.createDataFrame([("a", "PyTorch Lightning and lightning"), ("a", "Apache Spark")], "k string, x string")
    assert {r.skill for r in skills.extract(df, "k", "x", longest=True).collect()} == {"PyTorch Lightning", "Apache Spark"}
    assert {r.skill for r in skills.extract(df, "k", "x").collect()} == {"PyTorch Lightning", "PyTorch", "Apache Spark"}


def test_taxonomy_has_each_alias_once():
    aliases = [a for n, _, x in SKILLS for a in {n.lower(), *x}]
    assert len(SKILLS) == 109 and len(aliases) == len(set(aliases))


def test_gate_two_finds_names_that_are_not_listed(spark):
    """Every third name is kept from gate 1: on texts that the tagger did not see, it finds most of them, and little else."""
    posts = extraction.adverts(spark, "/root/testdata/sf0.01").cache()
    seen, unseen = (posts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == n) for n in range(2))
    tagger = skills.train(seen, "advert", extraction.LISTED)
    found = skills.extract(unseen, "doc_id", "advert", extraction.LISTED, tagger).filter("extraction_method = 'tagger'").collect()
    held = [(n, c, x) for n, c, x in SKILLS if n not in {s[0] for s in extraction.LISTED}]
    want = {(r.doc_id, name) for r in unseen.collect() for name, _ in skills.Automaton(held).skills([w.lower() for w, _ in skills.tokens(r.advert)], True)}
    named = {(r.doc_id, name) for r in found for name, _ in skills.Automaton(held).skills([w.lower() for w, _ in skills.tokens(r.skill)], True)}
    right = sum(bool(skills.Automaton(held).skills([w.lower() for w, _ in skills.tokens(r.skill)])) for r in found)
    precision, recall = right / max(1, len(found)), len(named & want) / len(want)
    print(f"gate 2: precision {precision:.3f}, recall {recall:.3f} of {len(want)}")
    assert precision > 0.8 and recall > 0.6
    assert all(r.confidence == skills.TAGGED and r.skill_category == "unlisted" for r in found)
