"""Lists of a bucket are merged as they come."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gridweave.llm import context_tree


def test_lists_are_merged_before_all_are_held(monkeypatch):
    texts = [f"text {k % 7} of {k % 11}" for k in range(300)]
    table = pa.table({"text": texts, "train": [k % 3 > 0 for k in range(300)]})
    whole = context_tree.bucket_lists(table, 5)
    most, merge = [], context_tree._merge
    monkeypatch.setattr(context_tree, "SLICE_BYTES", 200)
    monkeypatch.setattr(context_tree, "JOINED", 100)
    monkeypatch.setattr(context_tree, "_merge", lambda held: most.append(len(held)) or merge(held))
    parts = context_tree.bucket_lists(table, 5)
    for (a, b), (c, d) in zip(whole, parts, strict=True):
        assert np.array_equal(a, c) and np.array_equal(b, d)
    assert len(most) > 2 and max(most) < 20
