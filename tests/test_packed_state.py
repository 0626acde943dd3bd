"""Size of the keyed list state: a batch of rows is one element, not one per row."""

from __future__ import annotations

from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd

from clickloom.streaming import keyed_state


class Kept:
    """A list state and a timer in memory."""

    def __init__(self):
        self.elements, self.timers = [], set()
        self.appendValue, self.appendList = self.elements.append, self.elements.extend
        self.get, self.clear = lambda: iter(list(self.elements)), self.elements.clear

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_batch_is_one_element_and_keeps_its_nulls():
    kept, key = Kept(), (datetime(2024, 1, 2), 0)
    rows = keyed_state.WindowRows(["user", "item", "score"], ["user"], "item", "score", 2)
    rows.init(kept)
    first = pd.DataFrame({"user": np.arange(1_000) % 5, "item": np.arange(1_000), "score": np.arange(1_000) // 10})
    second = pd.DataFrame({"user": [None, 1, None, 1], "item": [7, 8, 6, 9], "score": [3, 500, 3, 500]})
    for part in (first, second):
        list(rows.handleInputRows(key, iter([part.assign(more="x")]), SimpleNamespace()))
    assert len(kept.elements) == 2 and len(kept.timers) == 1
    (best,) = rows.handleExpiredTimer(key, SimpleNamespace(), None)
    assert not kept.elements
    got = [(None if pd.isna(r.user) else int(r.user), int(r.item), int(r.score), int(r.rn)) for r in best.itertuples()]
    want = [(0, 990, 99, 1), (0, 995, 99, 2), (1, 8, 500, 1), (1, 9, 500, 2)]
    want += [(u, 990 + u + 5 * i, 99, i + 1) for u in (2, 3, 4) for i in range(2)] + [(None, 6, 3, 1), (None, 7, 3, 2)]
    assert got == want and set(best["window_end"]) == {key[0]}
