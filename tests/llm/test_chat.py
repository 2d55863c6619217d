import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import chat
from tidemark.llm.common import table


def random_model(seed):
    rng = np.random.default_rng(seed)
    return chat.Model(rng.random(chat.N) * 9, rng.random((chat.N, chat.N)) * 9, [rng.random((chat.N, w)) * 9 for w in chat.WIDTHS])


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    for seed in range(6):
        model = random_model(seed)
        scores = rng.normal(size=(4, chat.N))
        value = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:])) + sum(scores[k, s] for k, s in enumerate(p))
        want = max(itertools.product(range(chat.N), repeat=4), key=value)
        assert tuple(chat.decode(model, scores, [np.array([k]) for k in range(4)])) == want


def rows(seed, n=30):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 7, 40])):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            text = "\n".join(" ".join(["word"] * rng.randint(0, 40)) + ("?" if role == "user" else ".") for _ in range(rng.choice([1, 1, 3])))
            out.append((conv, turn, role, text))
    return out


def whole(out):
    """Per conversation its roles and canonical text."""
    found = {}
    for r in sorted(out, key=lambda r: (r.key, r.segment, r.part)):
        a, b = found.get(r.key, ("", ""))
        found[r.key] = (a + r.roles, b + r.rendered)
    return {k: (a, b + chat.END) for k, (a, b) in found.items()}


def reference(lines, model):
    """One plain Viterbi pass and one rendering a conversation."""
    by = {}
    for r in lines:
        by.setdefault(r.key, []).append(r)
    out = {}
    for key, rows in by.items():
        rows.sort(key=lambda r: (r.ord, r.line_no, r.line))
        best, back = None, []
        for r in rows:
            score = np.array([sum(e[s, f] for e, f in zip(model.emit, (r.f0, r.f1, r.f2))) for s in range(chat.N)])
            if best is None:
                best = model.start + score
            else:
                way = best[:, None] + model.step
                back.append(way.argmax(0))
                best = way.max(0) + score
        state = [int(best.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        roles, text = "", ""
        for n, (r, s) in enumerate(zip(rows, reversed(state))):
            name, opens = chat.STATES[s]
            line, bare = r.line, False
            if opens and chat.ROLES[r.f0 - 1 : r.f0] == (name,):
                bare = r.cut == len(line) > 0
                line = line[r.cut :]
            if opens:
                text += (chat.END if n else "") + f"<|{name}|>"
            text += "" if bare else "\n" + line
            roles += name[0].upper() if opens else name[0]
        out[key] = (roles, text + chat.END)
    return out


def featured(lines):
    return lines.select("key", "ord", "line_no", "line", "role", chat._marker_length(F.col("line")).alias("cut"), *chat._features(F.col("line"))).collect()


def test_segments_do_not_change_the_result(spark):
    turns = spark.createDataFrame(rows(1), "conv_id long, turn long, role string, text string")
    lines = chat.transcribe(turns)
    model = chat.train(lines)
    want = reference(featured(lines), model)
    for more in ({}, {"segment": 4, "group": 2}, {"segment": 1, "group": 3}, {"segment": 8, "part": 2}):
        assert whole(chat.parse(lines, model, **more).collect()) == want


def test_a_very_long_turn_is_cut(spark):
    text = "\n".join(f"line {k}." for k in range(300))
    turns = spark.createDataFrame([(1, 0, "user", "hello?"), (1, 1, "assistant", text), (1, 2, "user", "thanks")], "conv_id long, turn long, role string, text string")
    lines = chat.transcribe(turns)
    model = chat.train(lines)
    out = chat.parse(lines, model, part=50).collect()
    assert len(out) >= 8 and max(r.n_lines for r in out) <= 50
    assert whole(out) == reference(featured(lines), model)


def test_the_query_equals_a_plain_pass(spark):
    sf = "/root/testdata/sf0.01"
    turns = table(spark, sf, "conversations")
    lines = chat.transcribe(turns)
    model = chat.train(lines.filter(~chat.held_out(F.col("key"))))
    want = reference(featured(lines), model)
    out = {r.conv_id: r for r in chat.op9_chat_transcripts(spark, sf).collect()}
    assert set(out) == set(want)
    assert whole(chat.parse(lines, model).collect()) == want
    for key, (roles, text) in want.items():
        r = out[key]
        assert (r.n_lines, r.n_turns, r.rendered_chars) == (len(roles), sum(c.isupper() for c in roles), len(text))
    assert len({r.rendered_hash for r in out.values()}) == len({t for _, t in want.values()})
    held = [r for r in out.values() if r.held_out]
    assert 0 < len(held) < len(out)
    assert sum(r.wrong for r in held) < 0.15 * sum(r.n_lines for r in held) and sum(r.lost for r in out.values()) == 0


def test_content_that_looks_like_a_marker_stays(spark, sf_dir):
    model = chat.train(chat.transcribe(table(spark, sf_dir, "conversations")))
    text = "User: what is it?\nAssistant: see the\ncontext\nAnswer key below.\nsystem\nUser: ok?"
    df = spark.createDataFrame([(1, text)], "doc long, body string")
    rendered = whole(chat.parse(chat.lines_of(df, "doc", "body"), model).collect())[1][1]
    for line in ("\ncontext\n", "\nAnswer key below.\n", "\nsystem\n"):
        assert line in rendered


def test_plain_transcripts(spark, sf_dir):
    turns = chat.transcribe(table(spark, sf_dir, "conversations"))
    text = "System: be kind\nUser: how are you?\nAssistant: fine.\nthanks\nUser: good?"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "User: x")], "doc long, body string")
    got = {r.key: r for r in chat.parse(chat.lines_of(df, "doc", "body"), chat.train(turns)).collect()}
    assert set(got) == {1, 2, 3} and got[1].roles == "SUAaU"
    assert got[1].rendered == "<|system|>\nbe kind\n<|end|>\n<|user|>\nhow are you?\n<|end|>\n<|assistant|>\nfine.\nthanks\n<|end|>\n<|user|>\ngood?"
    assert got[2].n_lines == got[3].n_lines == 1


def test_nulls_ties_and_empty(spark):
    odd = [(1, 0, None, None), (1, 0, None, None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "robot", "beep"), (3, 0, "user", "beep\n")]
    turns = spark.createDataFrame([(*r, 1, "k", 2) for r in odd], "conv_id long, turn long, role string, text string, seg int, key string, part int")
    lines = chat.transcribe(turns)
    got = {r.key: r.n_lines for r in chat.parse(lines, chat.train(lines)).collect()}
    assert got == {1: 2, 3: 3}
    none = chat.transcribe(turns.limit(0))
    assert chat.conversations(chat.parse(none, chat.train(none))).collect() == []
