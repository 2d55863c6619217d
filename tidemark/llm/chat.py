"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. The hidden state of a line is its role (system, user, assistant)
and whether it opens a turn; what is seen is its speaker marker ("User:", "Q:", "### Assistant", none),
its length class and its ending. Start, transition and emission probabilities are counted over all
labelled turns (a few hundred sums, the only thing gathered), and Viterbi finds the likeliest states.

A conversation is cut into segments of `SEGMENT` consecutive order numbers (of `PART` lines where a turn
among them is longer), so one that holds a third of all lines is spread over tasks: each segment yields
a (max, +) matrix from entry to exit state, products of `GROUP` of them settle the states at the seams in
two steps, and each segment is then decoded on its own from them. The result is that of one pass over
the whole conversation.

A marker is taken off only after decoding, only where a line opens a turn, and only if it names the role
that was decoded; a speaker's word without mark or colon is content. Rendering is by line as well: a line
that opens a turn closes the one before it, so the texts of a conversation's segments, in order, followed
by END where there is any line, are its canonical form. A line that is nothing but a marker opens its
turn, whose text begins on the next line.

Defined results: a null text is one empty line; rows with a null key or order form no conversation
and are left out; rows of one key and order are taken in the order of their texts, and equal rows
are lines each; an unknown role in the labelled turns teaches nothing; without labelled turns only
markers tell the states apart. Ties go to the earlier state in STATES.
Columns other than those named are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import runs_of, table, whole_groups, write_table

ROLES = ("system", "user", "assistant")
#: Role and whether the line opens a turn, in the order that breaks ties.
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
#: Order numbers a segment; lines a segment where one of its turns has more; segments whose matrices meet at once.
SEGMENT, PART, GROUP = 64, 4096, 4096
#: Words that speakers are marked with, by role.
MARKERS = {"system": "system|sys|context|instructions?", "user": "user|human|customer|prompt|q", "assistant": "assistant|ai|bot|model|answer|a"}
SIZES = (1, 40, 120, 300)
OPEN, END = "<|{}|>", "\n<|end|>\n"
N = len(STATES)


def _pattern(words: str) -> str:
    """A word before a colon or a closing mark, or alone behind an opening mark."""
    return rf"(?i)^\s*(?:[#>*\[]*\s*(?:{words})\s*[:>\]]+\s*|[#>*\[]+\s*(?:{words})\s*$)"


def _marker(line: Column) -> Column:
    """0 none, 1 to 3 by role, 4 another name before a colon."""
    out = F.when(line.rlike(r"^\s*[#>*\[]*\s*[A-Z][\w ]{0,20}[:\]](\s|$)"), 4).otherwise(0)
    for n, words in reversed(list(enumerate(MARKERS.values(), 1))):
        out = F.when(line.rlike(_pattern(words)), n).otherwise(out)
    return out


def _marker_length(line: Column) -> Column:
    words = "|".join(MARKERS.values())
    return F.length(line) - F.length(F.regexp_replace(line, _pattern(words), ""))


def _features(line: Column) -> list[Column]:
    size = F.lit(0)
    for s in SIZES:
        size = size + (F.length(line) >= s).cast("int")
    ending = F.when(line.rlike(r"\?\s*$"), 2).when(line.rlike(r"[.!]\s*$"), 1).otherwise(0)
    return [_marker(line).cast("int").alias("f0"), size.alias("f1"), ending.alias("f2")]


WIDTHS = (5, len(SIZES) + 1, 3)


#: Pseudo-counts of the marker by state, which speak where few labelled turns do: a marker opens a turn of the role it names.
_MARKED = np.full((N, WIDTHS[0]), 0.1)
for _k, (_role, _opens) in enumerate(STATES):
    _MARKED[_k, 0] = 0.5 if _opens else 2.0
    _MARKED[_k, 4] = 0.5 if _opens else 0.2
    if _opens:
        _MARKED[_k, 1 + ROLES.index(_role)] = 2.0


class Model:
    """Log probabilities: start (states), step (from, to), emit (one table per feature: state, value)."""

    def __init__(self, start, step, emit):
        def log(x, prior=0.5):
            x = np.asarray(x, float) + prior
            return np.log(x / x.sum(-1, keepdims=True))

        opens = np.array([o for _, o in STATES])
        self.start = np.where(opens, log(start), -1e9)
        step = log(step)
        for a in range(N):  # a turn goes on in its own role
            for b in range(N):
                if not STATES[b][1] and STATES[a][0] != STATES[b][0]:
                    step[a, b] = -1e9
        self.step, self.emit = step, [log(e, p) for e, p in zip(emit, (_MARKED, 0.5, 0.5))]

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        return sum(e[:, f].T for e, f in zip(self.emit, features))


def train(lines: DataFrame) -> Model:
    """From labelled lines (key, ord, line_no, line, role): counts of features by state and of steps between states."""
    state = F.when(F.col("role").isin(*ROLES), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) * 2 - 2 + (F.col("line_no") > 0).cast("int"))
    known = lines.select("key", "ord", "line_no", state.cast("int").alias("state"), *_features(F.col("line"))).filter("state is not null")
    emit = [np.zeros((N, w)) for w in WIDTHS]
    for r in known.groupBy("state", "f0", "f1", "f2").count().collect():  # states x feature values
        for e, f in zip(emit, (r.f0, r.f1, r.f2)):
            e[r.state, f] += r["count"]
    turns = known.groupBy("key", "ord").agg(F.max("line_no").alias("last"), F.min("state").alias("state"))
    after = turns.select("key", (F.col("ord") - 1).alias("ord"), F.col("state").alias("next"))
    pairs = turns.join(after, ["key", "ord"], "left").groupBy("state", "next", (F.col("last") > 0).alias("long")).agg(F.count("*").alias("n"), F.sum("last").alias("more"))
    step = np.zeros((N, N))
    for r in pairs.collect():  # states squared, twice
        s = r.state - r.state % 2
        if r.long:
            step[s, s + 1] += r.n
            step[s + 1, s + 1] += r.more - r.n
        if r.next is not None:
            step[s + bool(r.long), r.next - r.next % 2] += r.n
    start = np.zeros(N)
    for r in turns.filter("ord = 0").groupBy("state").count().collect():
        start[r.state - r.state % 2] += r["count"]
    return Model(start, step, emit)


def decode(model: Model, scores: np.ndarray, chains: list[np.ndarray], entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """States of the lines of many chains. chains[t]: the t-th line of each chain that has one, longest first;
    entry: best scores by state before each chain (NaN: at a start); leave: its last state (-1: free)."""
    if not chains:
        return np.zeros(0, int)
    best, back = np.zeros((len(scores), N)), np.zeros((len(scores), N), np.int8)
    for t, at in enumerate(chains):
        if t == 0:
            best[at] = model.start + scores[at]
            if entry is not None and len(within := np.flatnonzero(~np.isnan(entry[:, 0]))):
                best[at[within]] = (entry[within][:, :, None] + model.step).max(1) + scores[at[within]]
        else:
            way = best[at - 1][:, :, None] + model.step
            back[at] = way.argmax(1)
            best[at] = way.max(1) + scores[at]
    out = np.full(len(scores), -1)
    size = np.zeros(len(chains[0]), int)
    for at in chains:
        size[: len(at)] += 1
    last = chains[0] + size - 1
    out[last] = best[last].argmax(1)
    if leave is not None:
        out[last] = np.where(leave >= 0, leave, out[last])
    for at in reversed(chains[1:]):
        out[at - 1] = back[at, out[at]]
    return out


def transfer(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one segment: the (max, +) matrix, best score from each state before it to each at its end, and the best scores at its end if it is the first."""
    m = np.where(np.eye(N, dtype=bool), 0.0, -np.inf)
    first = None
    for s in scores:
        m = (m[:, :, None] + model.step).max(1) + s
        first = model.start + s if first is None else (first[:, None] + model.step).max(0) + s
    return m, first


def product(matrices: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `transfer` gives, of segments in order."""
    m, first = matrices[0], firsts[0]
    for k in range(1, len(matrices)):
        m = (m[:, :, None] + matrices[k]).max(1)
        first = (first[:, None] + matrices[k]).max(0)
    return m, first


def seams(matrices: np.ndarray, firsts: np.ndarray, entry: np.ndarray | None = None, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Of segments in order: best scores before each (NaN: at a start), and the state each ends in. entry: scores before the first; leave: the last state (-1: free)."""
    before, ways = np.full((len(matrices), N), np.nan), []
    now = entry
    for k, m in enumerate(matrices):
        if now is None:
            way = np.tile(firsts[k], (N, 1))
        else:
            before[k] = now
            way = now[:, None] + m
        ways.append(way.argmax(0))
        now = way.max(0)
    out = np.zeros(len(matrices), int)
    state = int(now.argmax()) if leave < 0 else leave
    for k in reversed(range(len(matrices))):
        out[k] = state
        state = int(ways[k][state])
    return before, out


_LONG, _LIST = pa.int64(), pa.list_(pa.float64())


def _matrices(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.array(t["m"].to_pylist()).reshape(-1, N, N), np.array(t["first"].to_pylist()).reshape(-1, N)


def _settled(found: list) -> list[pa.Array]:
    entry = [None if np.isnan(e[0]) else e.tolist() for es, _ in found for e in es]
    return [pa.array(entry, _LIST), pa.array(np.concatenate([x for _, x in found]).astype(np.int32))]


def parse(lines: DataFrame, model: Model, segment: int = SEGMENT, part: int = PART, group: int = GROUP) -> DataFrame:
    """Per conversation and segment: key, segment, part, n_lines, n_turns, roles (one letter a line, upper case where a turn
    opens), rendered (canonical text), and, where lines tell (role, mark), wrong (lines whose role differs), lost (characters
    taken off that were no marker) and left (characters of markers that stayed)."""
    spark = lines.sparkSession
    truth = F.coalesce(F.col("role"), F.lit("")) if "role" in lines.columns else F.lit("")
    mark = F.coalesce(F.col("mark"), F.lit(0)) if "mark" in lines.columns else F.lit(None).cast("int")
    rows = lines.filter("key is not null and ord is not null").select(
        F.col("key").cast("long").alias("key"), F.expr(f"floor(ord / {segment})").cast("long").alias("seg"), F.col("ord").cast("long").alias("ord"), F.col("line_no").cast("long").alias("line_no"),
        F.coalesce("line", F.lit("")).alias("line"), truth.alias("role"), mark.alias("mark"),
    )
    rows = rows.select(*rows.columns, _marker_length(F.col("line")).alias("cut"), *_features(F.col("line")))
    # Segments that hold a turn of over `part` lines are cut again, by turn and lines.
    long = rows.filter(F.col("line_no") >= part).select("key", "seg").distinct().withColumn("long", F.lit(True))
    again = F.when(F.col("long"), F.expr(f"1 + pmod(ord, {segment}) * {1 << 40} + line_no div {part}")).otherwise(F.lit(0)).cast("long")
    rows = rows.join(long, ["key", "seg"], "left").withColumn("part", again).drop("long")
    ids, order = ["key", "seg", "part"], ["key", "seg", "part", "ord", "line_no", "line", "role", "mark", "cut", "f0", "f1", "f2"]
    rows = rows.select(*order)

    def matrix(batches):
        for t in whole_groups(batches, (0, 1, 2)):
            columns = [t[c].to_numpy() for c in ids]
            scores = model.score([t[f].to_numpy() for f in ("f0", "f1", "f2")])
            start, size = runs_of(columns)
            found = [transfer(model, scores[a : a + n]) for a, n in zip(start, size)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[start]) for c in columns), pa.array([m.ravel().tolist() for m, _ in found], _LIST), pa.array([f.tolist() for _, f in found], _LIST)], [*ids, "m", "first"])

    def shrink(batches):
        for t in whole_groups(batches, (0, 1)):
            key, big = t["key"].to_numpy(), t["big"].to_numpy()
            ms, firsts = _matrices(t)
            start, size = runs_of([key, big])
            found = [product(ms[a : a + n], firsts[a : a + n]) for a, n in zip(start, size)]
            yield pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(big[start]), pa.array([m.ravel().tolist() for m, _ in found], _LIST), pa.array([f.tolist() for _, f in found], _LIST)], ["key", "big", "m", "first"])

    def top(batches):
        for t in whole_groups(batches, (0,)):
            ms, firsts = _matrices(t)
            found = [seams(ms[a : a + n], firsts[a : a + n]) for a, n in zip(*runs_of([t["key"].to_numpy()]))]
            yield pa.RecordBatch.from_arrays([t["key"].combine_chunks(), t["big"].combine_chunks(), *_settled(found)], ["key", "big", "entry", "leave"])

    def settle(batches):
        for t in whole_groups(batches, (0, 1)):
            ms, firsts = _matrices(t)
            entry, leave = t["entry"].to_pylist(), t["leave"].to_numpy()
            runs = zip(*runs_of([t["key"].to_numpy(), t["big"].to_numpy()]))
            found = [seams(ms[a : a + n], firsts[a : a + n], None if entry[a] is None else np.array(entry[a]), int(leave[a])) for a, n in runs]
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ids), *_settled(found)], [*ids, "entry", "leave"])

    deal = lambda df, keys, by: df.repartition(*keys).sortWithinPartitions(*by)
    # A conversation with nothing beyond its first segment has no seams; of the others that segment is bounded, so the join is even.
    inner = rows.filter("seg <> 0 or part <> 0")
    begun = rows.filter("seg = 0 and part = 0").join(inner.select("key").distinct(), "key", "left_semi")
    mats = deal(inner.unionByName(begun), ids, order).mapInArrow(matrix, "key long, seg long, part long, m array<double>, first array<double>")
    mats = write_table(mats.withColumn("big", F.expr(f"seg div {group}")), "matrices")
    whole = deal(mats, ["key", "big"], ["key", "big", "seg", "part"]).select("key", "big", "m", "first")
    bigs = whole.mapInArrow(shrink, "key long, big long, m array<double>, first array<double>")
    tops = deal(bigs, ["key"], ["key", "big"]).mapInArrow(top, "key long, big long, entry array<double>, leave int")
    met = mats.join(tops, ["key", "big"]).select("key", "big", "seg", "part", "m", "first", "entry", "leave")
    met = deal(met, ["key", "big"], ["key", "big", "seg", "part"]).mapInArrow(settle, "key long, seg long, part long, entry array<double>, leave int")

    def render(batches):
        for t in whole_groups(batches, (0, 1, 2)):
            columns = [t[c].to_numpy() for c in ids]
            scores = model.score([t[f].to_numpy() for f in ("f0", "f1", "f2")])
            start, size = runs_of(columns)
            longest = np.argsort(-size, kind="stable")
            s, n = start[longest], size[longest]
            chains = [s[: np.searchsorted(-n, -k, "left")] + k for k in range(int(n[0]))]
            entry = np.array([e or [np.nan] * N for e in t["entry"].take(pa.array(s)).to_pylist()], float)
            states = decode(model, scores, chains, entry, t["leave"].to_numpy()[s])
            line, role, marks, cuts, spoken = (t[c].to_pylist() for c in ("line", "role", "mark", "cut", "f0"))
            out: list = [[] for _ in range(7)]
            for a, n in zip(start.tolist(), size.tolist()):
                text, roles, wrong, opened, lost, left = [], [], 0, 0, 0, 0
                first = t["entry"][a].as_py() is None
                for k in range(a, a + n):
                    name, opens = STATES[states[k]]
                    off = cuts[k] if opens and 0 < spoken[k] < 4 and ROLES[spoken[k] - 1] == name else 0
                    if opens:
                        text.append(("" if first else END) + OPEN.format(name))
                        opened += 1
                    if not off or off < len(line[k]):
                        text.append("\n" + line[k][off:])
                    first = False
                    roles.append(name[0].upper() if opens else name[0])
                    wrong += role[k] != "" and role[k] != name
                    if marks[k] is not None:
                        lost += max(0, off - marks[k])
                        left += max(0, marks[k] - off)
                for column, v in zip(out, (n, opened, "".join(roles), "".join(text), wrong, lost, left)):
                    column.append(v)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), _LONG, _LONG)
            names = [*ids, "n_lines", "n_turns", "roles", "rendered", "wrong", "lost", "left"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[start]) for c in columns), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    ready = deal(rows.join(met, ids, "left").withColumn("leave", F.coalesce("leave", F.lit(-1))), ids, order)
    out = ready.mapInArrow(render, "key long, seg long, part long, n_lines int, n_turns int, roles string, rendered string, wrong int, lost long, left long")
    return out.withColumnRenamed("seg", "segment")


def lines_of(transcripts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of whole transcripts: key, ord (the line's number), line_no 0, line."""
    cut = transcripts.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("ord", "line"))
    return cut.select("key", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("line_no"), "line")


#: How transcripts name their speakers, by style; the last two use words that no list above knows.
STYLES = (
    ("System: ", "User: ", "Assistant: "), ("Context: ", "Human: ", "AI: "), ("### System\n", "### Prompt\n", "### Answer\n"), ("[sys] ", "Q: ", "A: "),
    ("Setting: ", "Client: ", "Helper: "), ("[note] ", "[me] ", "[you] "),
)


def transcribe(turns: DataFrame) -> DataFrame:
    """Lines of raw transcripts from (conv_id, turn, role, text): one style a conversation; of ten markers about two are left
    out and one is damaged (its vowels are gone). mark: characters of the marker in the line."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    marks = F.array(*[F.create_map(*[F.lit(x) for pair in zip(ROLES, s) for x in pair]) for s in STYLES])
    chance = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10))
    lead = F.coalesce(marks[style][F.col("role")], F.lit(""))
    lead = F.when((chance < 2) & (F.col("turn") > 0), "").when(chance == 2, F.regexp_replace(lead, "[aeiouAEIOU]", "")).otherwise(lead)
    whole = turns.withColumn("_lead", lead).select(
        F.col("conv_id").alias("key"), F.col("turn").alias("ord"), "role", F.length(F.regexp_replace("_lead", "\n", "")).alias("_mark"),
        F.posexplode(F.split(F.concat("_lead", F.coalesce("text", F.lit(""))), "\n", -1)).alias("line_no", "line"),
    )
    return whole.select("key", "ord", "role", "line_no", "line", F.when(F.col("line_no") == 0, F.col("_mark")).otherwise(0).alias("mark"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def conversations(parsed: DataFrame) -> DataFrame:
    """Of `parse`: one row a conversation. rendered_hash names its segments' texts and their places, so it changes with any
    letter or order; it is an aggregate of two 64-bit hashes, and no conversation is gathered."""
    one = lambda seed: F.bit_xor(F.xxhash64("segment", "part", F.sha2("rendered", 256), F.lit(seed)))
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("n_lines", "n_turns", "wrong", "lost", "left")]
    chars = (F.sum(F.length("rendered")) + len(END)).alias("rendered_chars")
    out = parsed.groupBy("key").agg(*sums, chars, one(1).alias("_a"), one(2).alias("_b"))
    return out.withColumn("rendered_hash", F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("_a", "_b")]))).drop("_a", "_b")


def op9_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a raw transcript, its roles recovered and its turns rendered anew. The model learns from the
    conversations that are not held out; wrong, lost and left of the held-out ones are its errors."""
    lines = transcribe(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    model = train(lines.filter(~held_out(F.col("key"))))
    out = conversations(parse(lines, model))
    return out.select(F.col("key").alias("conv_id"), held_out(F.col("key")).alias("held_out"), *[c for c in out.columns if c != "key"])


QUERIES = {"op9_chat_transcripts": op9_chat_transcripts}
ORACLES: dict[str, str] = {}
