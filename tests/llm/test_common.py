import time

import numpy as np
import pyarrow as pa

from tidemark.llm import suffixes
from tidemark.llm.common import whole_groups


def batches(keys, size):
    return [pa.RecordBatch.from_arrays([pa.array(keys[s : s + size]), pa.array(np.arange(s, min(s + size, len(keys))))], ["k", "v"]) for s in range(0, len(keys), size)]


def test_groups_are_whole_and_none_is_lost():
    rng = np.random.default_rng(1)
    for _ in range(20):
        keys = np.sort(rng.integers(0, 12, 200))
        found = [t.column(0).to_numpy() for t in whole_groups(batches(keys, int(rng.integers(1, 40))), (0,))]
        assert np.array_equal(np.concatenate(found), keys)
        assert all(a[-1] != b[0] for a, b in zip(found, found[1:]))
    assert list(whole_groups([], (0,))) == [] and list(whole_groups(batches(np.zeros(0, int), 5), (0,))) == []


def test_a_group_over_many_batches_is_put_together_once():
    keys = np.zeros(400_000, np.int64)
    began = time.perf_counter()
    [found] = whole_groups(batches(keys, 256), (0,))
    assert found.num_rows == len(keys) and time.perf_counter() - began < 2


def test_a_trigger_in_very_many_blocks_is_counted_once_through():
    def marks(h):
        one = np.ones(len(h), np.int64)
        rows = [pa.array(h), pa.array(one), pa.array(one), pa.array(np.arange(len(h)))]
        return [pa.RecordBatch.from_arrays([c.slice(s, 256) for c in rows], ["h", "n", "phrases", "block"]) for s in range(0, len(h), 256)]

    h = np.concatenate((np.full(400_000, 3), np.arange(10, 700), np.full(3, 900)))
    began = time.perf_counter()
    found = [x for b in suffixes._repeated(1000)(iter(marks(h))) for x in zip(*(b.column(c).to_pylist() for c in ("h", "hot")))]
    assert time.perf_counter() - began < 4
    assert len(found) == 400_003 and {x for x in found} == {(3, True), (900, False)}
