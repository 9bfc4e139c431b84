"""NumPy helpers that work on Arrow batches of texts inside a task.

Texts are handled as one flat byte array with offsets. Long batches are cut into slices of a quarter of a
megabyte, so temporary arrays stay small whatever a batch or a document holds.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # units handled at a time
POSITION_BITS = np.uint64(22)  # a slice and the longest look-ahead fit in these
_POSITION = np.uint64((1 << 22) - 1)

_random = np.random.default_rng(20240229)
BYTE_CODE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _random.integers(
    0, 2, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, beside those of other
    operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64; kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < count:
        steps = np.full(max(count, SLICE + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * SLICE:  # longer ones are rare and not kept
            _powers[int(base)] = have
    return have[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Another scrambling of the same values for each seed."""
    return mixed(x + np.uint64((0xD1B54A32D192ED03 * (seed + 1)) & ((1 << 64) - 1)))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; `span_hash` takes the hash of any span out of them."""
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers(BASE, len(units)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of units[start:end], the same wherever an equal span lies."""
    return (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) \
        else pa.large_string()
    texts = texts.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def binary(parts: list, lengths: np.ndarray) -> pa.Array:
    """A binary array of these bytes, made of buffers: after pyarrow's own conversion of such lists a worker
    held some 100 MB more for the rest of its life."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if ends[-1] > np.iinfo(np.int32).max:
        return pa.array(parts, pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(parts))])


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole items with at most `limit` units; a longer item comes alone."""
    low, count = 0, len(offsets) - 1
    while low < count:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, count)
        low = high


def pieces(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut bytes at white space into pieces of about `limit`."""
    low = 0
    while low < len(data):
        high = low + limit
        while high < len(data):
            gaps = np.flatnonzero(IS_SPACE[data[high:high + limit]])
            if len(gaps):
                high += int(gaps[0])
                break
            high += limit
        yield low, min(high, len(data))
        low = high


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: (starts, ends, first word of each text and the total)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit code for each word, first word of each text and the total)."""
    codes, firsts, total = [], [np.zeros(1, dtype=np.int64)], 0
    for low, high in slices(offsets):
        part = data[offsets[low]:offsets[high]]
        if high - low > 1 or len(part) <= 2 * SLICE:
            cuts = [(0, len(part), offsets[low:high + 1] - offsets[low])]
        else:
            cuts = [(a, b, np.array([0, b - a])) for a, b in pieces(part, SLICE)]
        for a, b, inner in cuts:
            piece = part[a:b]
            starts, ends, first = word_places(piece, inner)
            sums = prefix_sums(BYTE_CODE[LOWER[piece] if lower else piece])
            codes.append(mixed(span_hash(sums, starts, ends)))
            if len(cuts) == 1:
                firsts.append(first[1:] + total)
            total += len(starts)
        if len(cuts) != 1:
            firsts.append(np.array([total]))
    return np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64), np.concatenate(firsts)


def shingles(codes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, hash) of the distinct runs of `size` codes of each item, sorted; an item with fewer
    codes counts as one run, an empty one has none."""
    counts = np.diff(first)
    items = np.repeat(np.arange(len(counts)), np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)))
    if not len(items):
        return items, np.zeros(0, dtype=np.uint64)
    runs = np.concatenate([[0], np.cumsum(np.bincount(items, minlength=len(counts)))])
    starts = first[items] + np.arange(len(items)) - runs[items]
    ends = np.minimum(starts + size, first[items + 1])
    hashes = np.zeros(len(items), dtype=np.uint64)
    for step in range(size):
        inside = starts + step < ends
        hashes[inside] = mixed(hashes[inside] * np.uint64(3) + codes[(starts + step)[inside]])
    order = np.lexsort((hashes, items))
    items, hashes = items[order], hashes[order]
    keep = np.ones(len(items), dtype=bool)
    keep[1:] = (items[1:] != items[:-1]) | (hashes[1:] != hashes[:-1])
    return items[keep], hashes[keep]


def anchored_runs(units: np.ndarray, first: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Cut the windows of every item into runs that share their smallest k-gram.

    Equal windows have the same smallest k-gram (their anchor) at the same place, so they can only
    meet in runs with equal anchors, and all windows of two runs are equal where the runs have equal
    content. Returns item, start (unit within the item), n (windows), offset (of the anchor in the run),
    anchor and content (hashes).
    """
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("item", "start", "n", "offset", "anchor", "content")}
    for low, high in slices(first):
        total = int(first[high] - first[low])
        if high - low == 1 and total > SLICE:
            cuts = [(first[low] + at, min(first[low] + at + SLICE + window - 1, first[high]))
                    for at in range(0, max(1, total - window + 1), SLICE)]
        else:
            cuts = [(first[low], first[high])]
        for begin, end in cuts:
            edges = np.clip(first[low:high + 1], begin, end) - begin
            _runs_of(units[begin:end], edges, window, gram, low, begin - first[low:high], found)
    kinds = {"item": np.int64, "start": np.int64, "n": np.int64, "offset": np.int64, "anchor": np.uint64,
             "content": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=kinds[k]) for k, v in found.items()}


def _runs_of(units, edges, window, gram, low, shift, found) -> None:
    span = window - gram + 1  # k-grams of a window
    if len(units) < window:
        return
    sums = prefix_sums(units)
    at = np.arange(len(units) - gram + 1)
    grams = mixed(span_hash(sums, at, at + gram))
    keys = (grams & ~_POSITION) | at.astype(np.uint64)
    blocks = -(-len(keys) // span) + 1
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(keys)] = keys
    padded = padded.reshape(blocks, span)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(units) - window + 1
    smallest = np.minimum(after[:count], before[span - 1:span - 1 + count]) & _POSITION
    lengths = np.diff(edges)
    numbers = np.maximum(lengths - window + 1, 0)
    items = np.repeat(np.arange(len(lengths)), numbers)
    if not len(items):
        return
    valid = np.repeat(edges[:-1] - np.concatenate([[0], np.cumsum(numbers)[:-1]]), numbers) + np.arange(len(items))
    chosen = smallest[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (items[1:] != items[:-1])
    heads = np.flatnonzero(new)
    n = np.diff(np.append(heads, len(valid)))
    begin, anchor = valid[heads], chosen[heads].astype(np.int64)
    content = span_hash(sums, begin, begin + n + window - 1)
    found["item"].append(low + items[heads])
    found["start"].append(begin + shift[items[heads]])
    found["n"].append(n)
    found["offset"].append(anchor - begin)
    found["anchor"].append(grams[anchor])
    found["content"].append(mixed(content + (n * 1024 + anchor - begin).astype(np.uint64)))


def covered(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Mask of the units that some span covers."""
    edges = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + lengths, total), -1)
    return np.cumsum(edges[:-1]) > 0
