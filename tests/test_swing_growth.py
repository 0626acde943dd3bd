"""What an item of one block hands on."""

from __future__ import annotations

import pyarrow as pa

from clickloom.operators import recommend


def test_an_item_of_one_block_hands_on_its_best_only():
    lists = [[1, 2], [1, 2, 3], [1, 2, 3, 4]]
    one = pa.table({"i": [1] * 3, "a": [0] * 3, "b": [0] * 3, "of": [1] * 3, "mult": [1] * 3, "items": lists})
    two = one.set_column(3, "of", pa.array([2] * 3))
    none = one.slice(0, 0)
    assert recommend._partial_swing(1.0, True, 1)(one, none).column("j").to_pylist() == [2]
    assert recommend._partial_swing(1.0, True, 1)(two, none).column("j").to_pylist() == [2, 3, 4]
