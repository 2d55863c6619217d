import random
import re

from tidemark.llm import licences

S = licences.SENTENCES


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, key string, hits int")
    return {r.doc_id: r for r in licences.scan(df).collect()}


def test_rules_and_sequences(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    rows = [
        (1, gpl),
        (2, "Words. Released under the MIT License. More words. Licensed under CC BY-NC 4.0."),
        (3, "* Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\n"),
        (4, "This text has a licence of its own kind."),
        (5, "No such thing here."),
        (6, "Released under the MIT License.\nReleased under the MIT License.\nReleased under the MIT License."),
        (7, "# " + gpl.replace(" the ", " the\n")),
        (8, "no end here\nReleased under the MIT License\nnor here"),
    ]
    got = scan(spark, rows)
    assert got[7].licences == ["GPL-3-or-later"] and got[8].licences == ["MIT"]
    assert got[1].licences == ["GPL-3-or-later"] and got[1].sentence_ids == ["gplTerms", "gplNoWarranty", "gplSee"]
    assert got[2].licences == ["CC-BY-NC-4.0", "MIT"] and got[2].status == "several"
    assert got[3].licences == ["Apache-2.0"]
    assert (got[4].status, got[4].n_unknown) == ("unknown", 1)
    assert (got[5].status, got[5].licences) == ("none", [])
    assert (got[6].licences, got[6].n_licence_sentences) == (["MIT"], 3)


def test_every_sentence_is_found_and_hinted(spark):
    rows = [(k, s.replace("<v>", "2.1").capitalize() + ("" if s.endswith(":") else ".")) for k, s in enumerate(S.values())]
    got = scan(spark, rows)
    assert [got[k].sentence_ids for k in range(len(rows))] == [[name] for name in S]


def test_nulls_empty_long(spark):
    long = "word " * 50_000 + "Released under the MIT License. " + "word " * 50_000
    got = scan(spark, [(1, None), (2, ""), (None, "Released under the MIT License."), (4, long)])
    assert got[1].status == got[2].status == "none" and got[None].licences == ["MIT"] and got[4].n_unknown + got[4].n_licence_sentences == 1
    assert scan(spark, []) == {}


def test_every_sentence_is_found_wrapped_at_each_blank(spark):
    rows, want = [], []
    for name, sentence in S.items():
        words = (sentence.replace("<v>", "2.1").capitalize() + ("" if sentence.endswith(":") else ".")).split(" ")
        for n in range(1, len(words)):
            if words[n - 1].endswith(":"):
                continue
            for gap in ("\n", "\t", "  "):
                rows.append((len(rows), " ".join(words[:n]) + gap + " ".join(words[n:])))
                want.append([name])
    rows.append((len(rows), 'This work is in the "public" domain.'))
    want.append(["publicDomain"])
    got = scan(spark, rows)
    assert [(rows[k][1], got[k].sentence_ids) for k in range(len(rows)) if got[k].sentence_ids != want[k]] == []


def test_wrapped_and_line_by_line_notices_in_one_document(spark):
    gpl = "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License version 2\nas published by the Free Software Foundation"
    rows = [
        (1, gpl + ".\n\nReleased under the MIT License\nData Team"),
        (2, "Released under the MIT License\nLicensed under CC BY 4.0\n" + gpl + "\nData Team"),
        (3, gpl + "\nReleased under the MIT License\n\nof no licence\nat all"),
        (4, "Words\nReleased under the\nMIT License\nits own licence\nAll rights\nreserved"),
    ]
    got = scan(spark, rows)
    assert got[1].licences == ["GPL-2-only", "MIT"] and (got[1].sentence_ids, got[1].n_unknown) == (["gplOnly", "mitReleased"], 0)
    assert got[2].sentence_ids == ["mitReleased", "ccBy", "gplOnly"] and got[2].licences == ["CC-BY-4.0", "GPL-2-only", "MIT"]
    assert got[3].sentence_ids == ["gplOnly", "mitReleased", "?"]
    assert got[4].sentence_ids == ["mitReleased", "?", "reserved"]


def plain(text):
    """The rules of the scan, read with plain loops: identifiers in order of position, unknown ones as ?, and licences."""
    a = re.ASCII
    quotes = "[\"'“”‘’]"

    def norm(s):
        s = re.sub(quotes, "", s.lower())
        s = re.sub(r"\s+", " ", re.sub(r"[0-9]+(\.[0-9]+)*", "<v>", s), flags=a)
        return re.sub(r"^[\s*#/;.!?-]+|[\s*#/;.!?]+$", "", s, flags=a)

    known = {sentence: name for name, sentence in S.items()}
    hinted = lambda s: re.search(licences.RAW_HINT, s.lower(), a)
    version = lambda s: (re.search(r"[0-9]+(\.[0-9]+)*", s) or [""])[0]
    hits = []
    for sentence in re.split(licences.WRAPPED, text or "", flags=a):
        if not hinted(sentence):
            continue
        if norm(sentence) in known:
            hits.append((known[norm(sentence)], version(sentence)))
            continue
        lines = [x for x in re.split(r"\n+", sentence) if re.sub(rf"{quotes}|\s", "", x, flags=a)]
        found, k = [], 0
        while len(lines) > 1 and k < len(lines):
            runs = [n for n in range(1, len(lines) - k + 1) if norm("\n".join(lines[k : k + n])) in known]
            if runs:
                run = "\n".join(lines[k : k + runs[-1]])
                found.append((known[norm(run)], version(run)))
            elif hinted(lines[k]):
                found.append(("?", ""))
            k += runs[-1] if runs else 1
        hits += found if any(name != "?" for name, _ in found) else [("?", "")]
    left, named = list(hits), set()
    for ids, licence in licences.RULES:
        k = 0
        while k + len(ids) <= len(left):
            if all(left[k + n] and left[k + n][0] == name for n, name in enumerate(ids)):
                named.add(licence.replace("{v}", left[k][1]))
                left[k : k + len(ids)] = [None]
            k += 1
    return [name for name, _ in hits], sorted(named)


def test_equals_a_plain_reading(spark):
    """Over the documents of two scales, and texts of notices that lines and paragraphs part in all kinds of ways."""
    rng = random.Random(9)
    said = [s.replace("<v>", rng.choice(["2", "3.0", "2.1"])) for s in S.values()]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice([*said, "a licence of its own", "plain words here", 'the "public domain" of old', "all rights\nreserved"]).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(1, max(2, len(words)))
                words[at:at] = [rng.choice(["\n", "\n# ", "\t", "\n\n"])]
            parts.append(" ".join(words) + rng.choice([".", "", "!", ":", ";"]))
        texts.append(rng.choice(["\n", " ", "\n\n", ". "]).join(parts))
    texts += [r.text for sf in ("sf0.001", "sf0.01") for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = scan(spark, list(enumerate(texts)))
    wrong = [(x, got[k].sentence_ids, got[k].licences, plain(x)) for k, x in enumerate(texts) if (got[k].sentence_ids, got[k].licences) != plain(x)]
    assert wrong[:3] == [] and sum(bool(got[k].licences) for k in range(len(texts))) > 200
