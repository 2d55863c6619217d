"""SentencePiece encoding and decoding with segmentations sampled without replacement.

A text's segmentations form a lattice: an edge for every vocabulary piece at every place, and byte
pieces for a character that no piece holds. The model file is a BPE one, whose scores are ranks, so a
piece's probability is taken by Zipf's law from its rank; a segmentation's is the product of its
pieces', normalised over the lattice.

The k segmentations of greatest perturbed log-probability (log-probability plus Gumbel noise) are k
draws without replacement. They are found top-down, as A* with exact bounds: a node of the search is a
set of segmentations with a common beginning, its bound the maximum of their perturbed values, which is
a Gumbel variable of the set's total mass and so can be drawn before the set is looked into. Taking a
node out follows its best segmentation to the end, by conditional draws, and puts back, for every place
passed, the set that turns off there, with its bound drawn below the one taken out. The (k+1)-th bound
is the threshold of the inclusion scores log P(perturbed value > threshold).

No piece goes from a character on into a blank, so the lattice falls into parts at blanks; a part seen
before is not built again. Draws are a hash of the row's key, the sample, the place: a row's samples do
not depend on the rows around it.

Defined results: a null or empty text has one segmentation, without pieces; a text with fewer than k
segmentations yields all of them, with inclusion score 0 (certain); a blank comes before the first
character, as the library has it, and decoding takes it off; the sign that stands for a blank in pieces
is encoded in bytes where a text itself holds it, so decoding gives every text back exactly. A null
key counts as 0 in the draws; equal rows have equal samples. Other columns are never read.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table
from tidemark.llm.phrases import mix

BLANK = "▁"
SAMPLES = 2
#: Edges that one worker remembers; beyond it starts anew.
EDGES = 6_000_000
_U = np.uint64
_RUNS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.bytes_of: list[bytes] = [b""] * len(every)
        self.byte_id = np.zeros(256, np.int64)
        plain = []
        for i in every:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((i, piece.replace(BLANK, " ")))
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        if any("\n" in p or " " in p.lstrip(" ") for _, p in plain):
            raise ValueError("a piece goes on into a blank or holds a line's end")
        plain.sort(key=lambda x: (-model.get_score(x[0]), x[0]))
        weight = 1 / (np.arange(len(plain)) + 2.0)
        rank_log = np.log(weight / weight.sum())
        self.byte_log = float(rank_log[-1]) - 1.0
        chars = sorted({c for _, p in plain for c in p})
        self.code = np.full(0x110000, -1, np.int64)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.chars = len(chars)
        nodes: dict[tuple[int, str], int] = {}
        piece_at, log_at = [-1], [0.0]
        for n, (i, p) in enumerate(plain):
            at = 0
            for c in p:
                at = nodes.setdefault((at, c), len(nodes) + 1)
                if at == len(piece_at):
                    piece_at.append(-1), log_at.append(0.0)
            piece_at[at], log_at[at] = i, float(rank_log[n])
        keys = np.array([a * self.chars + self.code[ord(c)] for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(nodes.values(), np.int64)[order]
        self.piece_at, self.log_at = np.array(piece_at), np.array(log_at)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of many pieces, joined, and each one's length."""
        if not hasattr(self, "_spelt"):
            length = np.array([len(b) for b in self.bytes_of])
            self._spelt = np.frombuffer(b"".join(self.bytes_of), np.uint8), length, np.cumsum(length) - length
        data, length, start = self._spelt
        width = length[ids]
        at = np.repeat((start[ids] - (np.cumsum(width) - width)).astype(np.int32), width)
        at += np.arange(len(at), dtype=np.int32)
        return data[at].tobytes(), width


class _Parts(dict):
    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


class Lattice:
    """The lattices of all parts seen: node arrays (first edge) and edge arrays (to, piece, probability), longest first."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self):
        self.parts = _Parts()
        self.start = np.zeros(0, np.int64)
        self.ptr = np.zeros(1, np.int64)
        self.to, self.piece, self.q, self.log_q, self.src, self.head = (np.zeros(0, t) for t in (np.int32, np.int32, float, float, np.int32, bool))

    def index(self, texts: list[str]) -> list[np.ndarray]:
        """Part numbers of each text."""
        if len(self.to) > EDGES:
            self.reset()
        get = self.parts.__getitem__
        out = [np.fromiter(map(get, _RUNS.findall(" " + t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if self.parts.new:
            self._build(self.parts.new)
            self.parts.new = []
        return out

    def _build(self, parts: list[str]):
        v, size = self.v, np.array([len(p) for p in parts])
        total = size + 1  # a node at each character and one at the end
        base = np.cumsum(total) - total
        n = int(total.sum())
        offset = np.arange(n) - np.repeat(base, total)
        left = np.repeat(size, total) - offset
        code, point = np.full(n, -2, np.int64), np.zeros(n, np.int64)
        point[left > 0] = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        code[left > 0] = v.code[point[left > 0]]
        src, length, piece, log_p = [], [], [], []
        at, step = np.flatnonzero(code >= 0), 0
        node = np.zeros(len(at), np.int64)
        covered = np.zeros(n, bool)
        while len(at):
            here = code[at + step]
            key = node * v.chars + here
            found = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            on = np.flatnonzero((here >= 0) & (v.keys[found] == key))
            at, node, step = at[on], v.child[found[on]], step + 1
            has = np.flatnonzero(v.piece_at[node] >= 0)
            ends = node[has]
            src.append(at[has]), length.append(np.full(len(has), step)), piece.append(v.piece_at[ends]), log_p.append(v.log_at[ends])
            if step == 1:
                covered[at[has]] = True
        lone = np.flatnonzero(~covered & (left > 0))  # characters for bytes
        width = 1 + (point[lone] > 0x7F) + (point[lone] > 0x7FF) + (point[lone] > 0xFFFF)
        # Longest first at each node: mostly the likeliest, which a draw tries first.
        src, length = np.concatenate([lone, *src[::-1]]), np.concatenate([np.ones(len(lone), int), *length[::-1]])
        piece, log_p = np.concatenate([-1 - point[lone], *piece[::-1]]), np.concatenate([width * v.byte_log, *log_p[::-1]])
        order = np.argsort(src, kind="stable")
        src, piece, log_p = src[order], piece[order], log_p[order]
        to, beta = src + length[order], np.zeros(n)
        many = np.bincount(src, minlength=n)
        ptr = np.cumsum(many) - many
        nodes = np.argsort(left.astype(np.int16) if size.max(initial=0) < 2**15 else left, kind="stable")
        cut = np.searchsorted(left[nodes], np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cut[:-1], cut[1:]):  # nodes by their distance from the end
            here = nodes[a:b]
            number = many[here]
            first = np.cumsum(number) - number
            edges = np.repeat(ptr[here] - first, number) + np.arange(first[-1] + number[-1])
            x = log_p[edges] + beta[to[edges]]
            most = np.maximum.reduceat(x, first)
            beta[here] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, number)), first))
        log_q = np.minimum(log_p + beta[to] - beta[src], 0.0)
        count, edges = len(self.ptr) - 1, len(self.to)
        self.ptr = np.concatenate((self.ptr, edges + np.cumsum(many)))
        self.start = np.concatenate((self.start, count + base))
        head = np.zeros(n, bool)
        head[base] = True
        self.head = np.concatenate((self.head, head))
        self.src, self.to = (np.concatenate((old, (new + count).astype(np.int32))) for old, new in ((self.src, src), (self.to, to)))
        self.piece, self.log_q = np.concatenate((self.piece, piece.astype(np.int32))), np.concatenate((self.log_q, log_q))
        self.q = np.concatenate((self.q, np.exp(log_q)))

    def walk(self, node: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one random path from each node to its part's end: (number of the walk, edge), in order. draw(walks, step) gives uniforms."""
        walks, step, seen, took = np.arange(len(node)), 0, [], []
        on = self.ptr[node] < self.ptr[node + 1]
        walks, node = walks[on], node[on]
        while len(node):
            edge, last = self.ptr[node], self.ptr[node + 1] - 1
            u = draw(walks, step) - self.q[edge]
            go = np.flatnonzero((u > 0) & (edge < last))
            while len(go):
                edge[go] += 1
                u[go] -= self.q[edge[go]]
                go = go[(u[go] > 0) & (edge[go] < last[go])]
            seen.append(walks), took.append(edge)
            node, step = self.to[edge], step + 1
            on = self.ptr[node] < self.ptr[node + 1]
            walks, node = walks[on], node[on]
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number, edges = np.concatenate(seen), np.concatenate(took)
        order = np.argsort(number, kind="stable")
        return number[order], edges[order]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids along a path, bytes spelt out."""
        piece = self.piece[edges]
        lone = piece < 0
        if not lone.any():
            return piece
        point = -1 - piece
        width = np.where(lone, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        out = np.repeat(piece, width)
        if (width[lone] == 1).all():
            out[np.repeat(lone, width)] = self.v.byte_id[point[lone]]
        else:
            spelt = "".join(map(chr, point[lone].tolist())).encode()
            out[np.repeat(lone, width)] = self.v.byte_id[np.frombuffer(spelt, np.uint8)]
        return out


def _uniform(seed: np.ndarray, kind: int, number: np.ndarray) -> np.ndarray:
    x = number.astype(np.uint64) + _U(kind * 0xD6E8FEB86659FD93 % 2**64)
    return ((mix(seed ^ mix(x)) >> _U(11)).astype(float) + 0.5) * 2.0**-53


def _below(phi, bound, u):
    """A Gumbel variable of log mass phi, given that it is below bound."""
    with np.errstate(over="ignore"):
        return phi - np.log(np.exp(phi - bound) - np.log(u))


def sample(lattice: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text, up to k of (ids, log probability, perturbed value, log inclusion probability), greatest perturbed value first."""
    parts = lattice.index(texts)
    n = len(texts)
    bound = -np.log(-np.log(_uniform(seeds, 1, np.zeros(n, np.int64))))
    paths: list[list[np.ndarray]] = [[] for _ in texts]  # edges
    ends: list[list[np.ndarray]] = [[] for _ in texts]  # log probability of each path up to a place
    pools: list[list] = [[] for _ in texts]
    values: list[list[float]] = [[] for _ in texts]
    live = list(range(n))
    heads = [np.zeros(0, np.int64)] * n
    starts = [lattice.start[p] for p in parts]
    froms, firsts = [0] * n, [0] * n
    for t in range(k):
        if not live:
            break
        size = [len(starts[d]) for d in live]
        owner = np.repeat(np.array(live), size)
        number = np.concatenate([np.arange(firsts[d], firsts[d] + s) for d, s in zip(live, size)])
        node = np.concatenate([starts[d] for d in live])
        seed = seeds[owner]
        walk, edge = lattice.walk(node, lambda w, step: _uniform(seed[w], 2 + 2 * t, number[w] * (1 << 24) + step))
        cut = np.searchsorted(walk, np.cumsum([0, *size]))
        flat = [np.concatenate((heads[d], edge[a:b])) for d, a, b in zip(live, cut[:-1], cut[1:])]
        lengths = np.array([len(f) for f in flat])
        every = np.concatenate(flat)
        log_q = lattice.log_q[every]
        sums = np.concatenate(([0.0], np.cumsum(log_q)))
        base = np.cumsum(lengths) - lengths
        before = sums[:-1] - np.repeat(sums[base], lengths) if len(every) else np.zeros(0)
        at = np.arange(len(every)) - np.repeat(base, lengths)
        options = lattice.ptr[lattice.src[every] + 1] - lattice.ptr[lattice.src[every]]
        turn = (options > 1) & (at >= np.repeat([froms[d] for d in live], lengths))
        where = np.flatnonzero(turn)
        own = np.repeat(np.array(live, int), lengths)[where]
        with np.errstate(divide="ignore"):
            phi = before[where] + np.log(-np.expm1(np.minimum(log_q[where], -1e-300)))
        g = _below(phi, bound[own], _uniform(seeds[own], 3 + 2 * t, at[where]))
        ask = np.searchsorted(where, np.append(base, len(every)))
        for j, d in enumerate(live):
            paths[d].append(flat[j])
            ends[d].append(before[base[j] : base[j] + lengths[j]])
            values[d].append(float(bound[d]))
            own_g = g[ask[j] : ask[j + 1]]
            best = np.argpartition(own_g, len(own_g) - (k - t))[len(own_g) - (k - t) :] if len(own_g) > k - t else np.arange(len(own_g))
            for b in best.tolist():
                place = int(at[where[ask[j] + b]])
                if own_g[b] > -np.inf:
                    heapq.heappush(pools[d], (-float(own_g[b]), t, place, (int(flat[j][place]),)))
        if t + 1 == k:
            break
        live = [d for d in live if pools[d]]
        for d in live:
            value, path, place, shut = heapq.heappop(pools[d])
            old = paths[d][path]
            src = int(lattice.src[old[place]])
            free = [e for e in range(lattice.ptr[src], lattice.ptr[src + 1]) if e not in shut]
            mass = np.cumsum(lattice.q[free])
            u = _uniform(seeds[d : d + 1], 1000 + t, np.array([place]))[0] * mass[-1]
            took = free[min(int(np.searchsorted(mass, u)), len(free) - 1)]
            bound[d] = -value
            if len(free) > 1:
                phi = ends[d][path][place] + np.log(sum(lattice.q[e] for e in free if e != took))
                again = _below(phi, bound[d], _uniform(seeds[d : d + 1], 2000 + t, np.array([place]))[0])
                heapq.heappush(pools[d], (-float(again), path, place, (*shut, took)))
            heads[d] = np.append(old[:place], took)
            froms[d] = place + 1
            # The rest of this part, then the parts after it.
            part = int(np.count_nonzero(lattice.head[lattice.src[old[: place + 1]]])) - 1
            firsts[d] = part
            starts[d] = np.append(lattice.to[took], lattice.start[parts[d][part + 1 :]])
    out = []
    for d in range(n):
        threshold = -pools[d][0][0] if pools[d] else -np.inf
        rows = []
        for edges, value in zip(paths[d], values[d]):
            log_p = float(lattice.log_q[edges].sum())
            x = log_p - threshold
            # log(1 - exp(-exp(x)))
            score = 0.0 if x > 4 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))
            rows.append((lattice.ids(edges), log_p, value, score))
        out.append(rows)
    return out


SCHEMA = "key {}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, k: int = SAMPLES) -> DataFrame:
    """key, sample (from 1), ids, log_prob, perturbed, log_inclusion: up to k distinct segmentations a row."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batch, lattice):
        texts = batch.column(2).to_pylist()
        found = sample(lattice, texts, batch.column(1).to_numpy().view(np.uint64).copy(), k)
        many = [len(rows) for rows in found]
        flat = [row for rows in found for row in rows]
        offsets = np.cumsum([0, *(len(r[0]) for r in flat)])
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[0] for r in flat]).astype(np.int32)))
        rank = [n for m in many for n in range(1, m + 1)]
        keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(texts)), many)))
        numbers = [pa.array([r[c] for r in flat], pa.float64()) for c in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([keys, pa.array(rank, pa.int32()), ids, *numbers], ["key", "sample", "ids", "log_prob", "perturbed", "log_inclusion"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))).alias("seed"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, run, SCHEMA.format(kind), lambda: Lattice(Vocabulary(path))).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The columns of `encoded` with `ids` replaced by ids_crc32 (little-endian unsigned 32-bit), n_ids, and text, the decoded text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    rest = [c for c in encoded.columns if c != ids]
    rows = encoded.select(ids, *rest)

    def run(batch, vocabulary):
        column = batch.column(0)
        cuts, flat = column.offsets.to_numpy(), column.values.to_numpy()
        flat = flat[cuts[0] : cuts[-1]]
        parts = [flat[a:b] for a, b in zip(cuts[:-1] - cuts[0], cuts[1:] - cuts[0])]
        data, width = vocabulary.spell(flat)
        ends = np.concatenate(([0], np.cumsum(width)))[cuts - cuts[0]]
        texts = [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        sums = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
        made = [pa.array(sums, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], "ids_crc32", "n_ids", "decoded"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return map_batches(rows, run, f"{schema}, ids_crc32 long, n_ids long, decoded string", lambda: Vocabulary(path))


def op5_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every whole text, each decoded again."""
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "sample", "n_ids", "ids_crc32", F.round("log_prob", 6).alias("log_prob"), F.round("log_inclusion", 6).alias("log_inclusion"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_gumbel_segmentations": op5_gumbel_segmentations}
ORACLES: dict[str, str] = {}
