"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output softmax.

Symbols are numbers in order of frequency; classes are stretches of neighbouring symbols. The probability of
a symbol is that of its class times its own within the class, both given the state. The state starts at zero
with a document, and is carried from window to window to the document's end; gradients end with the window.
Many documents run side by side in lanes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: The symbol that ends a document; it is also what a document's first symbol follows.
END, REST = 0, 1
#: States that meet the softmax at a time, so that their logits stay in the cache.
BLOCK = 2048
#: Logits within this need no greatest one taken off before exp.
FAR = 80.0


class Lanes:
    """Documents (arrays of symbols, each ending in END) laid end to end in lanes, longest lanes first."""

    def __init__(self, docs: list[np.ndarray], most: int):
        count = max(1, min(most, len(docs)))
        heap, lanes = [(0, n) for n in range(count)], [[] for _ in range(count)]
        for k in sorted(range(len(docs)), key=lambda k: (-len(docs[k]), k)):
            size, n = heapq.heappop(heap)
            lanes[n].append((size, k))
            heapq.heappush(heap, (size + len(docs[k]), n))
        sizes = sorted(((size, n) for size, n in heap), key=lambda x: (-x[0], x[1]))
        self.size = np.array([s for s, _ in sizes])
        self.symbol = np.zeros((count, self.size[0] + 1), np.uint16)  # a column ahead of the first
        self.owner = np.zeros((count, self.size[0]), np.int32)
        self.start = np.zeros((count, self.size[0]), bool)
        for at, (_, n) in enumerate(sizes):
            for begin, k in lanes[n]:
                stop = begin + len(docs[k])
                self.symbol[at, begin + 1 : stop + 1] = docs[k]
                self.owner[at, begin:stop] = k
                self.start[at, begin] = True

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, ...]]:
        """symbol before, symbol, whether a document starts, whether anything is there, document; all steps by lanes."""
        for t in range(0, int(self.size[0]), steps):
            on = int((self.size > t).sum())
            part = slice(t, min(t + steps, int(self.size[0])))
            before, symbol = self.symbol[:on, part].T, self.symbol[:on, part.start + 1 : part.stop + 1].T
            there = np.arange(part.start, part.stop)[:, None] < self.size[:on]
            yield np.ascontiguousarray(before), np.ascontiguousarray(symbol), self.start[:on, part].T, there, self.owner[:on, part].T


def rows(states: np.ndarray, there: np.ndarray) -> np.ndarray:
    """States (steps, lanes, hidden) as a row each, of those that are there."""
    flat = states.reshape(-1, states.shape[-1])
    return flat if there.all() else flat[there.ravel()]


class Model:
    """Parameters: x (input by symbol and gate), u (state by gate), c, c0 (classes), w, w0 (symbols within their class)."""

    NAMES = ("x", "u", "c", "c0", "w", "w0")

    def __init__(self, counts: np.ndarray, hidden: int, size: int, seed: int = 1):
        """counts: of each symbol, by which the model starts as the model of frequencies alone."""
        rng, symbols = np.random.default_rng(seed), len(counts)
        self.size, self.hidden, self.classes = size, hidden, -(-symbols // size)
        padded = np.zeros(self.classes * size)
        padded[:symbols] = np.asarray(counts, float) + 1
        mass = padded.reshape(self.classes, size)
        f = np.float32
        self.x = (rng.normal(size=(symbols, 3 * hidden)) * 0.1).astype(f)
        self.x[:, :hidden] += 0.5  # the state is kept rather than replaced
        self.u = (rng.normal(size=(hidden, 3 * hidden)) / hidden**0.5).astype(f)
        self.c = np.zeros((hidden, self.classes), f)
        self.c0 = np.log(mass.sum(1) / mass.sum()).astype(f)
        self.w = np.zeros((self.classes, size, hidden), f)
        self.w0 = np.where(mass > 0, np.log(np.maximum(mass, 1e-30) / mass.sum(1)[:, None]), -np.inf).astype(f)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, values: np.ndarray) -> Model:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at : at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size
        return self

    def _gates(self) -> np.ndarray:
        """u by gate: hidden by hidden each, a view."""
        return self.u.reshape(self.hidden, 3, self.hidden).swapaxes(0, 1)

    def run(self, before: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """States after each step (steps, lanes, hidden); gates z, r and n by step; and n's product with the state times -2, by step. h: lanes by hidden.

        A step works on whole blocks of memory, so that a window of few lanes costs few calls, and one of many streams.
        """
        size, (steps, lanes), symbols = self.hidden, before.shape, len(self.x)
        sign = np.array([-1, -1, -2], self.x.dtype)[:, None, None]  # a sigmoid is 1 / (1 + exp(-x)), a tanh 2 / (1 + exp(-2 x)) - 1
        by_gate = (self.x.reshape(symbols, 3, size).swapaxes(0, 1) * sign).reshape(-1, size)
        gates = np.take(by_gate, before[:, None].astype(np.intp) + np.arange(0, 3 * symbols, symbols)[:, None], axis=0)
        u = self._gates() * sign
        states, inner = np.empty((steps, lanes, size), h.dtype), []
        fresh = start.any(1)
        with np.errstate(over="ignore"):  # far out they are 0 and -1
            for t in range(steps):
                if fresh[t]:
                    h = h.copy()
                    h[start[t]] = 0
                a, g, after = np.matmul(h, u), gates[t], states[t]
                zr, n = g[:2], g[2]
                zr += a[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                n += np.multiply(zr[1], a[2], out=after)
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                inner.append(a[2])
                np.subtract(h, n, out=after)
                after *= zr[0]
                after += n
                h = after
        return states, gates, inner

    def _bounded(self, by: np.ndarray, bias: np.ndarray) -> bool:
        """Whether no logit of a state (whose components lie within 1) is beyond what exp can take; hidden is the last axis of by."""
        found = np.abs(by).sum(-1) + np.abs(np.where(np.isfinite(bias), bias, 0))
        return bool(found.max(initial=0) < FAR)

    def emit(self, states: np.ndarray, symbol: np.ndarray, learn: bool = False):
        """Natural log probability of each symbol given its state (a row each); with learn, the gradients of their sum's negative as well."""
        own = symbol // np.uint16(self.size)
        order = np.argsort(own, kind="stable")  # by radix: 16 bits
        ends = np.searchsorted(own[order], np.arange(self.classes + 1))
        states, symbol, own = np.take(states, order, axis=0), symbol[order], own[order].astype(np.intp)
        inside = symbol.astype(np.intp) - own * self.size
        near = bool(np.abs(states).max(initial=0) <= 1)
        plain_c, plain_w = near and self._bounded(self.c.T, self.c0), near and self._bounded(self.w, self.w0)
        out, place = np.empty(len(symbol), states.dtype), np.arange(min(len(symbol), BLOCK))
        down = np.empty_like(states) if learn else None

        def chosen(by, bias, plain, h, at):
            e = by @ h.T
            e += bias[:, None]
            if not plain:
                e -= e.max(0)
            told = e[at, place[: len(at)]]
            np.exp(e, out=e)
            total = e.sum(0)
            told -= np.log(total)
            if learn:
                e *= np.reciprocal(total, out=total)
                e[at, place[: len(at)]] -= 1
            return told, e

        by = np.ascontiguousarray(self.c.T)
        if learn:
            grads = {n: np.zeros_like(getattr(self, n)) for n in ("c", "c0", "w", "w0")}
        for begin in range(0, len(symbol), BLOCK):
            at = slice(begin, begin + BLOCK)
            h = states[at]
            out[at], e = chosen(by, self.c0, plain_c, h, own[at])
            if learn:
                np.matmul(e.T, by, out=down[at])
                grads["c"] += (e @ h).T
                grads["c0"] += e.sum(1)
        for k in np.flatnonzero(np.diff(ends)):
            for begin in range(ends[k], ends[k + 1], BLOCK):
                at = slice(begin, min(begin + BLOCK, ends[k + 1]))
                h = states[at]
                found, e = chosen(self.w[k], self.w0[k], plain_w, h, inside[at])
                out[at] += found
                if learn:
                    down[at] += e.T @ self.w[k]
                    grads["w"][k] += e @ h
                    grads["w0"][k] += e.sum(1)
        told = np.empty_like(out)
        told[order] = out
        if learn:
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            return told, np.take(down, back, axis=0), grads
        return told

    def gradients(self, window: tuple, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Sum of log probabilities of a window, gradients of its negative, and the state after it. h: hidden by lanes."""
        before, symbol, start, there, _ = window
        h = np.ascontiguousarray(h.T)
        states, gates, inner = self.run(before, start, h)
        size, (steps, lanes) = self.hidden, before.shape
        out, flat, grads = self.emit(rows(states, there), symbol[there], True)
        if len(flat) == there.size:
            down = flat.reshape(states.shape)
        else:
            down = np.zeros_like(states)
            down[there] = flat
        last = np.concatenate([h[None], states[:-1]])
        last[start] = 0
        d = np.empty((3, steps, lanes, size), h.dtype)  # with respect to the state's product with u
        dn = np.empty_like(states)  # with respect to n's input
        back, dh, more = np.ascontiguousarray(self._gates().swapaxes(1, 2)), np.zeros_like(h), np.empty_like(h)
        fresh = start.any(1)
        for t in range(steps - 1, -1, -1):
            (z, r, n), own, (dz, dr, da) = gates[t], dn[t], d[:, t]
            dh += down[t]
            np.subtract(1, z, out=more)
            more *= dh
            np.subtract(last[t], n, out=dz)
            dz *= more
            dz *= z
            np.multiply(n, n, out=own)
            np.subtract(1, own, out=own)
            own *= more
            np.multiply(own, r, out=da)
            np.subtract(1, r, out=dr)
            dr *= inner[t]
            dr *= -0.5
            dr *= da
            dh *= z
            for part in np.matmul(d[:, t], back):
                dh += part
            if fresh[t]:
                dh[start[t]] = 0
        plain = last.reshape(-1, size).T
        grads["u"] = np.concatenate([plain @ d[g].reshape(-1, size) for g in range(3)], axis=1)
        given = before.ravel()
        order = np.argsort(given, kind="stable")
        given = given[order]
        first = np.flatnonzero(np.append(True, given[1:] != given[:-1]))
        summed = [np.add.reduceat(np.take(g.reshape(-1, size), order, axis=0), first, axis=0) for g in (d[0], d[1], dn)]
        grads["x"] = given[first], np.concatenate(summed, axis=1)
        return float(out.sum(dtype=np.float64)), grads, states[-1].T

    def learn(self, docs: list[np.ndarray], lanes: int, steps: int, rate: float, memory: dict) -> int:
        """One pass of Adagrad over the documents, a window at a time; memory: its sums of squares, kept between calls."""
        laid, seen, h = Lanes(docs, lanes), 0, None
        for window in laid.windows(steps):
            count = window[0].shape[1]
            h = np.zeros((self.hidden, count), np.float32) if h is None else h[:, :count]
            tokens = int(window[3].sum())
            _, grads, h = self.gradients(window, h)
            for name, g in grads.items():
                value = getattr(self, name)
                if name not in memory:
                    memory[name] = np.full_like(value, 1.0)
                at, g = g if name == "x" else (slice(None), g)
                g = np.clip(g / tokens**0.5, -5, 5)
                past = memory[name][at] + g * g
                memory[name][at] = past
                value[at] -= rate * g / np.sqrt(past)
            seen += tokens
        return seen

    def score(self, docs: list[np.ndarray], lanes: int, steps: int) -> np.ndarray:
        """log10 probability of each whole document."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        laid, h = Lanes(docs, lanes), None
        for before, symbol, start, there, owner in laid.windows(steps):
            count = before.shape[1]
            h = np.zeros((count, self.hidden), np.float32) if h is None else h[:count]
            states, _, _ = self.run(before, start, h)
            h = states[-1]
            found = self.emit(rows(states, there), symbol[there])
            out += np.bincount(owner[there], found.astype(np.float64), len(docs))
        return out / np.log(10)
