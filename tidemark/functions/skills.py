"""Skills named in texts: an automaton over all aliases, and a tagger that finds names the taxonomy does not list.

Gate 1 (confidence 1, or 0.9 for an alias): one automaton of all aliases, built once a task, passes over a text's words once,
however many aliases there are. Gate 2 (confidence 0.7): an averaged perceptron tags words as beginning, inside or
outside a name. It is trained on what gate 1 is sure of, by the words' shapes and surroundings and never by the
words themselves, so it knows a name by how it is written and where it stands.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vocabulary import SKILLS

FOUND = "skill string, skill_category string, extraction_method string, confidence double"
_TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}+#./-]*")
_END = regex.compile(r"[./-]+$")
#: Texts that the tagger learns from, those of least hash, and passes over them.
SAMPLE, EPOCHS = 2000, 5
SURE, ALIAS, TAGGED = 1.0, 0.9, 0.7


def tokens(text: str) -> list[tuple[str, str]]:
    """Words in lower case as the automaton meets them, each with what stands between it and the word before."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        word = _END.sub("", m.group())
        out.append((word, text[at : m.start()]))
        at = m.start() + len(word)
    return out


class Automaton:
    """All aliases, met word by word: an alias begins and ends with a word."""

    def __init__(self, taxonomy=SKILLS):
        import ahocorasick

        self.words, known = ahocorasick.Automaton(), defaultdict(list)
        for name, category, aliases in taxonomy:
            for alias in {name.lower(), *aliases}:
                known[" ".join(w for w, _ in tokens(alias))].append((name, category, SURE if alias == name.lower() else ALIAS))
        for alias, skills in known.items():
            self.words.add_word(f" {alias} ", (alias.count(" ") + 1, skills))
        if known:
            self.words.make_automaton()
        self.empty = not known

    def spans(self, words: list[str], longest: bool = False) -> list[tuple[int, int, list]]:
        """First word, words and skills of each match; with longest, none inside a longer one."""
        if self.empty:
            return []
        line = f" {' '.join(words)} "
        found = [(line.count(" ", 0, end) - n, n, skills) for end, (n, skills) in self.words.iter(line)]
        if longest:
            found = [a for a in found if not any(b[1] > a[1] and b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1] for b in found)]
        return found

    def skills(self, words: list[str], longest: bool = False) -> dict[tuple[str, str], float]:
        out: dict = {}
        for _, _, skills in self.spans(words, longest):
            for name, category, sure in skills:
                out[name, category] = max(sure, out.get((name, category), 0.0))
        return out


def _shape(word: str) -> str:
    kinds = ["9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word]
    return "".join(k for n, k in enumerate(kinds) if not n or k != kinds[n - 1])


class Tagger:
    """Averaged perceptron over O, B and I, read from left to right."""

    TAGS = ("O", "B", "I")

    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}

    @staticmethod
    def features(rows: list[tuple[str, str]], sure: list[str], k: int, last: str) -> list[str]:
        """Of word k: nothing that says which word it is."""
        word = lambda n: rows[n][0].lower() if 0 <= n < len(rows) else "-"
        shape = lambda n: _shape(rows[n][0]) if 0 <= n < len(rows) else "-"
        gap = lambda n: rows[n][1].strip() or "_" if 0 <= n < len(rows) else "-"
        near = lambda n: sure[n] if 0 <= n < len(rows) else "-"
        start = "start" if k == 0 or any(c in rows[k][1] for c in ".!?\n") else "in"
        own = shape(k)
        return [
            "bias", f"s {own}", f"st {start} {own}", f"w-1 {word(k - 1)}", f"w+1 {word(k + 1)}", f"w-2 {word(k - 2)} {word(k - 1)}", f"g {gap(k)} {gap(k + 1)}", f"gs {gap(k)} {own}", f"n {near(k - 1)} {near(k + 1)} {own}",
            f"nn {near(k - 2)} {gap(k)} {own}", f"np {near(k + 2)} {word(k + 1)} {own}", f"s-1 {shape(k - 1)} {own}", f"s+1 {own} {shape(k + 1)}", f"t {last}", f"tg {last} {gap(k)} {own}", f"len {min(len(rows[k][0]), 6)}",
        ]

    def best(self, features: list[str], last: str) -> str:
        scores = dict.fromkeys(self.TAGS, 0.0)
        for f in features:
            for tag, w in self.weights.get(f, {}).items():
                scores[tag] += w
        allowed = self.TAGS if last != "O" else ("O", "B")
        return max(allowed, key=lambda tag: (scores[tag], tag))

    def train(self, texts: list[str], automaton: Automaton, epochs: int = EPOCHS) -> Tagger:
        """Learn from gate 1's spans. What is written like a name but is not listed may be one: it teaches nothing."""
        data = []
        for text in texts:
            rows = tokens(text)
            tags = labels(rows, automaton)
            unsure = [t == "O" and k > 0 and not any(c in rows[k][1] for c in ".!?\n") and _shape(rows[k][0]) not in ("x", "9") for k, t in enumerate(tags)]
            if any(t != "O" for t in tags):
                data.append((rows, tags, unsure))
        weights, sums, stamps, now = defaultdict(lambda: defaultdict(float)), defaultdict(float), defaultdict(int), 0

        def move(feature, tag, by):
            sums[feature, tag] += (now - stamps[feature, tag]) * weights[feature][tag]
            stamps[feature, tag] = now
            weights[feature][tag] += by

        self.weights = weights
        for _ in range(epochs):
            for rows, tags, unsure in data:
                last = "O"
                for k, tag in enumerate(tags):
                    now += 1
                    if not unsure[k]:
                        features = self.features(rows, tags, k, last)
                        guess = self.best(features, last)
                        if guess != tag:
                            for f in features:
                                move(f, tag, 1.0)
                                move(f, guess, -1.0)
                    last = tag
        out: dict = {}
        for f, by_tag in weights.items():
            for tag, w in by_tag.items():
                mean = (sums[f, tag] + (now - stamps[f, tag]) * w) / max(1, now)
                if mean:
                    out.setdefault(f, {})[tag] = mean
        self.weights = out
        return self

    def names(self, rows: list[tuple[str, str]], automaton: Automaton) -> list[str]:
        """Names that gate 1 does not know, as they are written."""
        sure, out, last, held = labels(rows, automaton), [], "O", []
        for k in range(len(rows) + 1):
            tag = "O" if k == len(rows) or sure[k] != "O" else self.best(self.features(rows, sure, k, last), last)
            if held and tag != "I":
                out.append(" ".join(held))
                held = []
            if tag in ("B", "I"):
                held.append(rows[k][0])
            last = tag if k == len(rows) or sure[k] == "O" else sure[k]
            if k < len(rows) and sure[k] != "O":
                last = "O"
        return out


def labels(rows: list[tuple[str, str]], automaton: Automaton) -> list[str]:
    """O, B, I by gate 1's longest matches."""
    out = ["O"] * len(rows)
    for start, n, _ in automaton.spans([w.lower() for w, _ in rows], True):
        out[start : start + n] = ["B"] + ["I"] * (n - 1)
    return out


def train(df: DataFrame, text: str, taxonomy=SKILLS, sample: int = SAMPLE) -> Tagger:
    """A tagger learnt from the `sample` texts of least hash (a bounded sample)."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("x")).select("x", F.xxhash64("x").alias("h")).orderBy("h").limit(sample)
    return Tagger().train([r.x for r in rows.collect()], Automaton(taxonomy))


def extract(df: DataFrame, key: str, text: str, taxonomy=SKILLS, tagger: Tagger | None = None, longest: bool = False) -> DataFrame:
    """(key, skill, skill_category, extraction_method, confidence), a row a key and skill. Rows of one key are one text; a null text names nothing.

    With a tagger, names that gate 1 does not know follow, of category unlisted, as they are written.
    """
    told = df.sparkSession.sparkContext.broadcast((taxonomy, tagger))  # the fixed taxonomy and the tagger's weights

    def run(batches):
        taxonomy, tagger = told.value
        automaton = Automaton(taxonomy)
        for batch in batches:
            at, out = [], []
            for n, x in enumerate(batch.column(1).to_pylist()):
                rows = tokens(x or "")
                found = [(s, c, "taxonomy", sure) for (s, c), sure in automaton.skills([w.lower() for w, _ in rows], longest).items()]
                if tagger is not None:
                    found += [(s, "unlisted", "tagger", TAGGED) for s in dict.fromkeys(tagger.names(rows, automaton))]
                at += [n] * len(found)
                out += found
            if out:
                columns = [pa.array(c, pa.string() if k < 3 else pa.float64()) for k, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["key", "skill", "skill_category", "extraction_method", "confidence"])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {FOUND}")
    one = found.groupBy("key", "skill", "skill_category", "extraction_method").agg(F.max("confidence").alias("confidence"))
    return one.withColumnRenamed("key", key)
