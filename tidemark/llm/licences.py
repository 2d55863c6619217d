"""Licence scans by sentence rules (native: DataFrame functions only).

A text is cut into sentences, lines joined; each is normalised and looked up among known licence sentences. In one
that is not known as a whole, every line may end a sentence: from each line on, the longest run of lines that is
known counts, and each other line with a licence word is unknown (where no run is known, the sentence is, once).
The sequence of identifiers found is matched, rule by rule in a fixed order, against
rules that name a licence. A rule that matches consumes its sentences, so a general rule never
claims what a specific one has used. All of it is row-local: no shuffle, no broadcast, no Python,
and no row or sentence is held beyond its own document.

Defined results: a null or empty text has no sentences, no licences and status "none". A text with
licence words in a sentence that no identifier knows has status "unknown" unless a rule matched.
Repeated sentences count each time; of equal rules the earlier wins. Columns of the input other
than the key and the text are never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Known licence sentences after normalisation (lower case, versions as <v>, quotes and
#: surrounding marks gone, runs of blanks single), by identifier.
SENTENCES: dict[str, str] = {
    "gplWork": "this work is licensed under the gnu general public license, version <v>",
    "gplTerms": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version <v> of the license, or (at your option) any later version",
    "gplTermsOld": "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version <v> of the license, or (at your option) any later version",
    "gplOnly": "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license version <v> as published by the free software foundation",
    "gplNoWarranty": "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "gplSee": "see the gnu general public license for more details",
    "gplReceived": "you should have received a copy of the gnu general public license along with this program",
    "lgplTerms": "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version <v> of the license, or (at your option) any later version",
    "lgplNoWarranty": "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgplSee": "see the gnu lesser general public license for more details",
    "lgplWork": "licensed under the gnu lesser general public license, version <v>",
    "agplWork": "licensed under the gnu affero general public license, version <v>",
    "mitReleased": "released under the mit license",
    "mitLicensed": "licensed under the mit license",
    "mitPerm": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:",
    "mitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asIs": "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "apacheShort": "licensed under the apache license, version <v>",
    "apacheTerms": "licensed under the apache license, version <v> (the license); you may not use this file except in compliance with the license",
    "apacheCopy": "you may obtain a copy of the license at",
    "apacheBasis": "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "apacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "ccByNc": "licensed under cc by-nc <v>",
    "ccByNcSa": "licensed under cc by-nc-sa <v>",
    "ccByNcNd": "licensed under cc by-nc-nd <v>",
    "ccBySa": "licensed under cc by-sa <v>",
    "ccByNd": "licensed under cc by-nd <v>",
    "ccBy": "licensed under cc by <v>",
    "ccByLong": "this work is licensed under a creative commons attribution <v> international license",
    "ccBySaLong": "this work is licensed under a creative commons attribution-sharealike <v> international license",
    "ccZero": "licensed under cc<v> <v>",
    "bsdPerm": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsdSource": "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsdBinary": "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsdWork": "released under the bsd license",
    "mplTerms": "this source code form is subject to the terms of the mozilla public license, v. <v>",
    "mplWork": "licensed under the mozilla public license, version <v>",
    "iscPerm": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "publicDomain": "this work is in the public domain",
    "reserved": "all rights reserved",
}

#: Ordered rules (identifier sequence, licence). "{v}" takes the version of the first sentence.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("gplTerms", "gplNoWarranty", "gplSee"), "GPL-{v}-or-later"),
    (("gplTermsOld", "gplNoWarranty", "gplSee"), "GPL-{v}-or-later"),
    (("gplOnly", "gplNoWarranty", "gplSee"), "GPL-{v}-only"),
    (("lgplTerms", "lgplNoWarranty", "lgplSee"), "LGPL-{v}-or-later"),
    (("gplTerms",), "GPL-{v}-or-later"),
    (("gplTermsOld",), "GPL-{v}-or-later"),
    (("gplOnly",), "GPL-{v}-only"),
    (("lgplTerms",), "LGPL-{v}-or-later"),
    (("gplWork",), "GPL-{v}"),
    (("lgplWork",), "LGPL-{v}"),
    (("agplWork",), "AGPL-{v}"),
    (("apacheTerms", "apacheCopy", "apacheBasis", "apacheSee"), "Apache-{v}"),
    (("apacheTerms",), "Apache-{v}"),
    (("apacheShort",), "Apache-{v}"),
    (("mitPerm", "mitNotice", "asIs"), "MIT"),
    (("mitPerm", "mitNotice"), "MIT"),
    (("mitReleased",), "MIT"),
    (("mitLicensed",), "MIT"),
    (("bsdPerm", "bsdSource", "bsdBinary", "bsdEndorse"), "BSD-3-Clause"),
    (("bsdPerm", "bsdSource", "bsdBinary"), "BSD-2-Clause"),
    (("bsdWork",), "BSD"),
    (("ccByNcSa",), "CC-BY-NC-SA-{v}"),
    (("ccByNcNd",), "CC-BY-NC-ND-{v}"),
    (("ccByNc",), "CC-BY-NC-{v}"),
    (("ccBySa",), "CC-BY-SA-{v}"),
    (("ccByNd",), "CC-BY-ND-{v}"),
    (("ccBy",), "CC-BY-{v}"),
    (("ccByLong",), "CC-BY-{v}"),
    (("ccBySaLong",), "CC-BY-SA-{v}"),
    (("ccZero",), "CC0-1.0"),
    (("mplTerms",), "MPL-{v}"),
    (("mplWork",), "MPL-{v}"),
    (("iscPerm", "asIs"), "ISC"),
    (("iscPerm",), "ISC"),
    (("unlicense",), "Unlicense"),
    (("publicDomain",), "Public-Domain"),
]

#: A sentence can be known, or suspected, only if it holds one of these; every entry of SENTENCES does.
HINT = r"licen[cs]e|copyright|warrant|redistribut|permission|public domain|all rights reserved|copy of the gnu|copies of the software"
#: The same words as they stand in a raw text, where a line's end, more blanks or a quote may part the words of a phrase.
RAW_HINT = HINT.replace(" ", r"[\"'“”‘’]*\s[\s\"'“”‘’]*")
#: Sentence ends: a full stop, exclamation or question mark before a blank (a stop after a lone v, as in "v. 2.0", ends
#: nothing), a colon before a list, and either every line's end or only an empty line: notices come one to a line and wrapped.
_ENDS = r"(?<=[^\sv][.!?])\s+|(?<=:)\s+(?=[\d*(-])|"
BY_LINE, WRAPPED = _ENDS + r"\n+", _ENDS + r"\n\s*\n"
VERSION = r"\d+(?:\.\d+)*"


def _normal(sentence: Column) -> Column:
    """Lower case, versions as <v>, straight quotes and edge marks removed, single blanks."""
    out = F.regexp_replace(F.lower(sentence), r"[\"'“”‘’]", "")
    out = F.regexp_replace(out, VERSION, "<v>")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.regexp_replace(out, r"^[\s*#/;.!?-]+|[\s*#/;.!?]+$", "")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, licences, sentence_ids, n_licence_sentences, n_unknown, status."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    # The cheap test on the whole text spares most documents the cutting; it drops no sentence that could be known.
    hinted = F.col("body").rlike(f"(?i){RAW_HINT}")
    none = F.array().cast("array<string>")

    said = F.when(hinted, F.filter(F.split(F.col("body"), WRAPPED), lambda s: F.lower(s).rlike(RAW_HINT))).otherwise(none)
    rows = rows.withColumn("hits", F.flatten(F.transform(said, lambda s: _hits(s, known))))
    # ";id=version;" per sentence: a rule is a substring search over whole entries, and what it used becomes "|".
    line = F.concat(F.lit(";"), F.array_join(F.transform("hits", lambda h: F.concat(h["id"], F.lit("="), h["v"])), ";"), F.lit(";"))
    state = F.struct(line.alias("left"), none.alias("found"))
    for ids, licence in RULES:
        # Entries share their separators: the sequence is read up to, not through, its closing ";".
        pattern = "".join(f";{name}=([^;]*)" for name in ids) + "(?=;)"
        state = _step(state, pattern, licence)
    out = rows.withColumn("end", F.when(F.size("hits") > 0, state).otherwise(F.struct(F.lit("").alias("left"), none.alias("found"))))
    unknown = F.size(F.filter("hits", lambda h: h["id"] == "?"))
    licences = F.array_sort(F.array_distinct("end.found"))
    return out.select(
        F.col("key").alias(key),
        licences.alias("licences"),
        F.transform("hits", lambda h: h["id"]).alias("sentence_ids"),
        (F.size("hits") - unknown).alias("n_licence_sentences"),
        unknown.alias("n_unknown"),
        F.when(F.size(licences) > 1, "several").when(F.size(licences) == 1, "known").when(F.size("hits") > 0, "unknown").otherwise("none").alias("status"),
    )


#: No known sentence has more words, so none stands on more lines.
LONGEST = max(len(s.split()) for s in SENTENCES.values())


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hit(name: Column, sentence: Column) -> Column:
    return F.struct(name.alias("id"), F.regexp_extract(sentence, VERSION, 0).alias("v"))


def _hits(sentence: Column, known: Column) -> Column:
    """The identifiers, with versions, of a sentence with licence words, in order of position."""
    lines = F.filter(F.split(sentence, r"\n+"), lambda s: F.regexp_replace(s, r"[\s\"'“”‘’]+", "") != "")
    begun = F.array(*[F.lit(s) for s in SENTENCES.values()])

    def within(ls: Column) -> Column:
        def run(i: Column) -> Column:
            """The longest known run of lines from line i on: its identifier, text and length, or null."""
            runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(ls) - i)), lambda n: F.array_join(F.slice(ls, i + 1, n), "\n"))
            named = F.transform(runs, lambda s, n: F.struct(known[_normal(s)].alias("id"), s.alias("s"), (n + 1).alias("n")))
            return F.get(F.reverse(F.filter(named, lambda r: r["id"].isNotNull())), F.lit(0))  # null where no run is known

        def at(state: Column, i: Column) -> Column:
            """Lines below "upto" are used; a line that begins no known sentence is not tried."""
            line = F.element_at(ls, i + 1)
            starts = _let(_normal(line), lambda s: (s != "") & F.exists(begun, lambda k: k.startswith(s)))
            lone = F.when(F.lower(line).rlike(RAW_HINT), F.array(_hit(F.lit("?"), line))).otherwise(empty)
            tried = lambda r: F.when(r.isNull(), F.struct((i + 1).alias("upto"), F.concat(state["hits"], lone).alias("hits"))).otherwise(
                F.struct((i + r["n"]).alias("upto"), F.concat(state["hits"], F.array(_hit(r["id"], r["s"]))).alias("hits"))
            )
            return F.when(i < state["upto"], state).when(starts, _let(run(i), tried)).otherwise(F.struct((i + 1).alias("upto"), F.concat(state["hits"], lone).alias("hits")))

        empty = F.array().cast("array<struct<id:string,v:string>>")
        begin = F.struct(F.lit(0).alias("upto"), empty.alias("hits"))
        found = F.aggregate(F.sequence(F.lit(0), F.size(ls) - 1), begin, at, lambda s: s["hits"])
        unknown = F.array(_hit(F.lit("?"), sentence))
        return F.when(F.size(ls) < 2, unknown).otherwise(_let(found, lambda f: F.when(F.exists(f, lambda h: h["id"] != "?"), f).otherwise(unknown)))

    return _let(known[_normal(sentence)], lambda name: F.when(name.isNotNull(), F.array(_hit(name, sentence))).otherwise(_let(lines, within)))


def _step(state: Column, pattern: str, licence: str) -> Column:
    """Apply one rule: note the licence for each match and consume the sentences matched."""
    # A lambda's argument is a bound variable: evaluated once, where a nested expression would be copied per use.
    def apply(s: Column) -> Column:
        versions = F.regexp_extract_all(s["left"], F.lit(pattern), F.lit(1))
        names = F.transform(versions, lambda v: F.replace(F.lit(licence), F.lit("{v}"), v))
        hit = s["left"].rlike(pattern)
        return F.struct(
            F.when(hit, F.regexp_replace(s["left"], pattern, ";|")).otherwise(s["left"]).alias("left"),
            F.when(hit, F.concat(s["found"], names)).otherwise(s["found"]).alias("found"),
        )

    return F.element_at(F.transform(F.array(state), apply), 1)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences, identifiers and counts, flattened for comparison by value."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_licence_sentences", "n_unknown", "status")


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    keys, names = ", ".join(q(s) for s in SENTENCES.values()), ", ".join(q(n) for n in SENTENCES)
    steps, last = [], "s0"
    for k, (ids, licence) in enumerate(RULES, 1):
        pattern = "".join(f";{name}=([^;]*)" for name in ids)
        # RE2 has no look-ahead: every entry's separator is doubled, so a rule takes its own closing one.
        pattern = ";" + ";;".join(f"{name}=([^;]*)" for name in ids) + ";"
        steps.append(
            f"s{k} AS (SELECT doc_id, ids, nk, nu, list_concat(found, list_transform(regexp_extract_all(l, {q(pattern)}, 1), lambda v: replace({q(licence)}, '{{v}}', v))) AS found, regexp_replace(l, {q(pattern)}, ';|;', 'g') AS l FROM {last})"
        )
        last = f"s{k}"
    said = lambda end: f"CASE WHEN hinted THEN list_filter(string_split(regexp_replace(t, '\\{end}', chr(1), 'g'), chr(1)), lambda s: regexp_matches(lower(s), {q(HINT)})) ELSE []::VARCHAR[] END"
    normal = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), '[\"''“”‘’]', '', 'g'), '\\d+(?:\\.\\d+)*', '<v>', 'g'), '\\s+', ' ', 'g'), '^[\\s*#/;.!?-]+|[\\s*#/;.!?]+$', '', 'g')"
    hits = lambda c: f"list_transform({c}, lambda s: {{'id': coalesce(m[{normal}], '?'), 'v': regexp_extract(s, '\\d+(?:\\.\\d+)*')}})"
    num = lambda c, op: f"len(list_filter({c}, lambda x: x.id {op} '?'))"
    return f"""
    WITH known AS (SELECT map([{keys}], [{names}]) AS m),
    ends AS (SELECT doc_id, regexp_matches(lower(coalesce(text, '')), {q(HINT)}) AS hinted,
        regexp_replace(regexp_replace(text, '([^\\sv][.!?])\\s+', '\\1' || chr(1), 'g'), '(:)\\s+([\\d*(-])', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents),
    marked AS (SELECT doc_id, {said("n+")} AS a, {said("n" + chr(92) + "s*" + chr(92) + "n")} AS b FROM ends),
    read AS (SELECT doc_id, {hits("a")} AS a, {hits("b")} AS b FROM marked, known),
    hits AS (SELECT doc_id, CASE WHEN {num("b", "<>")} > {num("a", "<>")} OR ({num("b", "<>")} = {num("a", "<>")} AND {num("b", "=")} < {num("a", "=")}) THEN b ELSE a END AS h FROM read),
    s0 AS (SELECT doc_id, list_transform(h, lambda x: x.id) AS ids, len(list_filter(h, lambda x: x.id <> '?')) AS nk, len(list_filter(h, lambda x: x.id = '?')) AS nu,
        []::VARCHAR[] AS found, array_to_string(list_transform(h, lambda x: ';' || x.id || '=' || x.v || ';'), '') AS l FROM hits),
    {", ".join(steps)},
    fin AS (SELECT doc_id, list_sort(list_distinct(found)) AS licences, ids, nk, nu FROM {last})
    SELECT doc_id, array_to_string(licences, ',') AS licences, array_to_string(ids, ',') AS sentence_ids, nk::INT AS n_licence_sentences, nu::INT AS n_unknown,
        CASE WHEN len(licences) > 1 THEN 'several' WHEN len(licences) = 1 THEN 'known' WHEN len(ids) > 0 THEN 'unknown' ELSE 'none' END AS status FROM fin"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": _oracle()}
