"""Fast similarity sketching: MinHash-like sketches whose every coordinate is filled.

Round i throws each element of a set into one bin and keeps, per bin, the smallest (round, value). The
first `size` rounds pick the bin by a hash; the next `size` rounds send all elements to one bin after
the other, so after 2 * `size` rounds at the latest no bin is empty. Later rounds only matter to bins
that are still empty, and a set is done when it has none. Equal coordinates of two sketches estimate
their Jaccard similarity with strong concentration, for small sets too.
"""

from __future__ import annotations

import numpy as np

from tasteloom.llm.arrays import mixed, seeded

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_sketches(items: np.ndarray, hashes: np.ndarray, count: int, size: int) -> np.ndarray:
    """Sketches, shape (count, size), of `count` sets given as (item, element hash), sorted by item.
    An empty set keeps EMPTY everywhere."""
    if size > 127:
        raise ValueError("a round number has to fit in a byte")
    sketch = np.full(count * size, EMPTY, dtype=np.uint64)
    level = np.full(count * size, EMPTY, dtype=np.uint64)  # smallest value of the round that fills a bin
    present = np.unique(items)
    for turn in range(2 * size):
        if not len(items):
            break
        value = seeded(hashes, turn)
        if turn < size:
            bins = (value % np.uint64(size)).astype(np.int64)
        else:
            bins = np.full(len(items), turn - size, dtype=np.int64)
        place = items * size + bins
        # A bin that an earlier round filled keeps its value: the round is the leading byte.
        empty = sketch[place] == EMPTY
        np.minimum.at(level, place[empty], mixed(value[empty]) >> np.uint64(8))
        fresh = place[empty]
        sketch[fresh] = (np.uint64(turn) << np.uint64(56)) | level[fresh]
        open_ = (sketch.reshape(count, size)[present] == EMPTY).any(axis=1)
        if not open_.all():
            present = present[open_]
            keep = np.zeros(count, dtype=bool)
            keep[present] = True
            items, hashes = items[keep[items]], hashes[keep[items]]
    return sketch.reshape(count, size)
