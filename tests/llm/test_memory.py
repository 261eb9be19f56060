import tracemalloc

import numpy as np

from plansift.llm import divergence as D


def test_counts_of_a_task_are_added_up_in_little_memory():
    rng, n, kinds = np.random.default_rng(1), 1 << 20, 5000
    ids = D.TermIds()
    for i in range(kinds):
        ids[b"t%d" % i]
    parts = [np.unique(rng.integers(0, kinds, 700).astype(np.int32)) for _ in range(n // 700)]
    gathered = [(i % 3, i % 40 - 1, part, np.ones(len(part), np.int64)) for i, part in enumerate(parts)]
    total = sum(len(part) for part in parts)
    tracemalloc.start()
    found, rows = 0, 0
    for batch in D.added_up(gathered, ["a", "b", "c"], ids):
        assert batch.num_rows <= D.OUT_ROWS
        found += batch.column("e").flatten().field("n").to_numpy().sum()
        rows += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # each entry is held once, in columns of 20 bytes and an order of 8
    assert found == total and rows == 3 * kinds and not gathered and peak < 64 * total
