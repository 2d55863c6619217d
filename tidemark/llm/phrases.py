"""Phrases of a text by rolling-hash triggers, in numpy over blocks of many documents.

Every window of `min_bytes` bytes takes as its trigger the place in it whose `gram`-byte rolling
hash is least (the first such place). The choice depends on the window's bytes alone, so equal
windows have equal triggers wherever they stand. Consecutive windows with one trigger form a phrase:
the bytes from the first of these windows to the end of the last. Phrases overlap so that every
window lies whole in exactly one, which is what makes the parse prefix-free for this length.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
BLOCK = 1 << 18
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive bytes, by doubling: each step joins two neighbours."""
    power = lambda n: _U(pow(_MULT, n, 2**64))
    have, part = None, _TABLE[data]
    size, got = 1, 0
    while True:
        if width & size:
            if have is None:
                have, got = part, size
            else:
                n = len(data) - got - size + 1
                have = have[:n] * power(size) + part[got : got + n]
                got += size
        if size * 2 > width:
            break
        n = len(part) - size
        part = part[:n] * power(size) + part[size:]
        size *= 2
    return mix(have.copy() if have is part else have)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks(texts: list[bytes], min_bytes: int):
    """Blocks of whole short texts or of overlapping parts of a long one: (bytes, [(text, its offset there, at, end)])."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if len(text) < min_bytes:
            continue
        if size + len(text) > BLOCK and held:
            yield b"".join(t for t, *_ in held), [x for _, *x in held]
            held, size = [], 0
        if len(text) > BLOCK:
            step = BLOCK - min_bytes + 1
            for off in range(0, len(text) - min_bytes + 1, step):
                part = text[off : off + BLOCK]
                yield part, [[k, off, 0, len(part)]]
            continue
        held.append((text, k, 0, size, size + len(text)))
        size += len(text)
    if held:
        yield b"".join(t for t, *_ in held), [x for _, *x in held]


def parse(texts: list[bytes], min_bytes: int, gram: int = GRAM):
    """Yields, a block at a time: block bytes, text number, offset of block in text, first and last window of each phrase, trigger hash."""
    bits = _U(BLOCK.bit_length() - 1)
    low = _U(BLOCK - 1)
    for data, parts in blocks(texts, min_bytes):
        raw = np.frombuffer(data, np.uint8)
        grams = rolling(raw, gram)
        keyed = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min(keyed, min_bytes - gram + 1) & low).astype(np.int64)
        valid = np.zeros(len(at) + 1, bool)
        for _, _, start, end in parts:
            valid[start : end - min_bytes + 1] = True
        where = np.flatnonzero(valid)
        if not len(where):
            continue
        took = at[where]
        new = np.ones(len(where), bool)
        new[1:] = (np.diff(where) != 1) | (np.diff(took) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(where)) - 1
        i0, i1 = where[first], where[last]
        part = np.searchsorted(np.array([p[2] for p in parts]), i0, "right") - 1
        number = np.array([p[0] for p in parts])[part]
        shift = np.array([p[1] - p[2] for p in parts])[part]
        yield data, number, shift, i0, i1, grams[took[first]]
