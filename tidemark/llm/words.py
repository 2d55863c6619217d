"""Words of many texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

import numpy as np

from tidemark.llm.phrases import _TABLE, mix

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Powers that a worker keeps; a longer batch makes its own and lets them go.
KEPT = 1 << 21


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_ODD, _BACK):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps, out=steps))
    if n <= KEPT:
        _powers[:] = made
    return made


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, scaled back, hash any stretch of bytes by its content."""
    up, _ = _grown(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, back = _grown(len(sums))
    return mix((sums[end] - sums[start]) * back[start])


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space; `data` ends with white space."""
    solid = np.zeros(len(data) + 1, bool)
    solid[1:] = ~SPACE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[0::2], edge[1::2]
