"""Runs of repeated word sequences: all maximal periodic stretches of each text.

A stretch with period q and at least EXPONENT * q words has, between its first and its last period, at least
(EXPONENT - 1) * q consecutive places where a word equals the one q later, and so at least one at a multiple of
that number. These places are a harmonic grid: n / q of them for every q. Where the two words there are equal,
the longest common extensions to both sides give the whole stretch.

Common extensions come from a difference cover (Burkhardt and Karkkainen 2003): only suffixes that start at
covered positions are sorted, by doubling. From any two positions a few steps, at most COVER words, lead to a
pair of covered ones; beyond it the extension is a range minimum over the common prefixes of neighbours in the
sorted order, read off a sparse table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteloom.llm import arrays

EXPONENT = 4
LEAST = 6  # words of a run
COVER = 21
COVERED = (0, 1, 6, 8, 18)  # all differences modulo 21, by enumeration in the tests
WORDS = 1 << 17  # words of texts that are indexed together
GRID = 1 << 19  # grid places looked at together
LOOK = 4  # words compared on each side of a grid place before it counts as a candidate

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs string, kept_text string")

_in_cover = np.zeros(COVER, dtype=bool)
_in_cover[list(COVERED)] = True
# _STEP[i, j]: the fewest steps after which i + step and j + step (modulo COVER) are both covered.
_STEP = np.array([[next(k for k in range(COVER) if _in_cover[(i + k) % COVER] and _in_cover[(j + k) % COVER])
                   for j in range(COVER)] for i in range(COVER)])


class CommonExtensions:
    """Lengths of the longest common prefixes of suffixes of `units`.

    The last words must differ from all others: they end every comparison inside the array.
    """

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.n = n
        # Words beyond the end are unlike anything.
        self.units = np.concatenate([units, np.arange(-1, -2 * COVER - 1, -1)]).astype(np.int64)
        where = np.arange(n)
        sample = where[_in_cover[where % COVER]]
        first = self.units[sample[:, None] + np.arange(COVER)]
        _, rank = np.unique(first.astype(">i8").view(f"V{8 * COVER}").ravel(), return_inverse=True)
        place = np.full(n + COVER, -1, dtype=np.int64)  # number of a sampled position
        place[sample] = np.arange(len(sample))
        levels = [rank]
        reach = COVER
        while len(sample) and rank.max() + 1 < len(sample):
            # Position + reach is covered too; beyond the end the rank is -1, once, as positions there differ.
            after = np.where(sample + reach < n, rank[place[np.minimum(sample + reach, n)]], -1)
            pair = rank * (len(sample) + 1) + after + 1
            _, rank = np.unique(pair, return_inverse=True)
            levels.append(rank)
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.full(n, -1, dtype=np.int64)
        self.rank[sample] = rank
        self.table = self._minima(self._neighbours(sample[order], place, levels))

    def _neighbours(self, ordered: np.ndarray, place: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sampled suffix and the next one in the sorted order."""
        x, y = ordered[:-1].copy(), ordered[1:].copy()
        total = np.zeros(len(x), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            inside = (x < self.n) & (y < self.n)
            equal = np.zeros(len(x), dtype=bool)
            equal[inside] = levels[level][place[x[inside]]] == levels[level][place[y[inside]]]
            step = COVER << level
            total[equal] += step
            x[equal] += step
            y[equal] += step
        return total + self._direct(x, y, np.full(len(x), COVER))

    def _direct(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from x and y on, at most `most` (up to COVER)."""
        found = np.zeros(len(x), dtype=np.int64)
        alive = np.arange(len(x))
        for step in range(int(most.max(initial=0))):
            alive = alive[most[alive] > step]
            a, b = x[alive] + step, y[alive] + step
            top = len(self.units) - 1
            alive = alive[(a <= top) & (b <= top) & (self.units[np.minimum(a, top)] == self.units[np.minimum(b, top)])]
            found[alive] += 1
        return found

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        """Sparse table: level k has the minima of 2^k neighbours."""
        table = [values]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def lengths(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, for arrays of different positions."""
        step = _STEP[x % COVER, y % COVER]
        found = self._direct(x, y, step)
        far = np.flatnonzero(found == step)
        far = far[(x[far] + step[far] < self.n) & (y[far] + step[far] < self.n)]
        a, b = self.rank[x[far] + step[far]], self.rank[y[far] + step[far]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1  # exact floor of the logarithm
        for k in np.unique(level):
            some = level == k
            row = self.table[k]
            found[far[some]] += np.minimum(row[low[some]], row[high[some] - (1 << k)])
        return found


def _grid(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period): the harmonic grids of all documents, a bounded number of places at a time."""
    for doc, (low, high) in enumerate(zip(first, first[1:])):
        n = int(high - low)
        period = np.arange(1, n // EXPONENT + 1)
        # Places 0, 3q, 6q, ... below n - q.
        number = (n - period - 1) // ((EXPONENT - 1) * period) + 1
        ends = np.cumsum(number)
        at = 0
        while at < len(period):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID, "right")))
            some, q = number[at:to], np.repeat(period[at:to], number[at:to])
            step = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            yield np.full(len(q), doc), low + step * (EXPONENT - 1) * q, q
            at = to


def candidates(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid places where the word equals the one a period later, and so do up to LOOK words after or before
    it. One side of a place in a run has at least half of the (EXPONENT - 1) * q equal places."""
    found = []
    for doc, place, q in _grid(first):
        equal = np.flatnonzero(units[place] == units[place + q])
        doc, place, q = doc[equal], place[equal], q[equal]
        low, high = first[doc], first[doc + 1]
        half = -(-(EXPONENT - 1) * q // 2)
        sides = []
        for sign in (1, -1):
            good = np.ones(len(place), dtype=bool)
            for step in range(1, LOOK + 1):
                a = place + sign * step
                inside = (a >= low) & (a + q < high)
                same = np.zeros(len(a), dtype=bool)
                same[inside] = units[a[inside]] == units[a[inside] + q[inside]]
                good &= same | (step >= half)
            sides.append(good)
        keep = sides[0] | sides[1]
        found.append((doc[keep], place[keep], q[keep]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))


def runs(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, length, period) of all runs of the documents `units[first[k]:first[k + 1]]`
    (codes >= 0), by document, start and period."""
    doc, place, q = candidates(units, first)
    if len(doc):
        involved = np.unique(doc)
        # Only documents with a candidate are indexed, each ended by a word of its own.
        sizes = first[involved + 1] - first[involved]
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        inside = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
        text = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
        text[inside] = units[np.arange(sizes.sum()) + np.repeat(first[involved] - (np.cumsum(sizes) - sizes), sizes)]
        text[begin + sizes] = int(units.max()) + 1 + np.arange(len(sizes))
        number = np.searchsorted(involved, doc)
        x = place - first[doc] + begin[number]
        # Mirrored, the end marks stand before their documents, so one more goes behind all.
        mirrored = np.append(text[-2::-1], text[-1])
        after = CommonExtensions(text).lengths(x, x + q)
        before = CommonExtensions(mirrored).lengths(len(text) - 2 - x - q, len(text) - 2 - x)
        start, equal = x - before + 1, before + after - 1
        length = equal + q
        keep = (equal >= (EXPONENT - 1) * q) & (length >= LEAST)
        number, start, length, q = number[keep], start[keep], length[keep], q[keep]
        # A stretch is met by several places and with multiples of its period.
        order = np.lexsort((q, length, start, number))
        number, start, length, q = number[order], start[order], length[order], q[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (number[1:] != number[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        number, start, length, q = number[new], start[new] - begin[number[new]], length[new], q[new]
        order = np.lexsort((q, start, number))
        return involved[number[order]], start[order], length[order], q[order]
    return doc, place, q, q


def widened(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail, in one document of ten by the crc32 of its id."""
    code = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or code % 10 or not n:
        return words
    g = code // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def highest(start: list[int], length: list[int], period: list[int]) -> int | None:
    """Number of the run with the greatest length / period; of equal ones the first, as they are sorted."""
    best = None
    for k in range(len(start)):
        if best is None or length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def _described(batches: Iterator[pa.RecordBatch], widen: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text")
        at = 0
        while at < len(ids):
            words, codes, first = [], {}, [0]
            begin = at
            units = []
            while at < len(ids) and (at == begin or len(units) < WORDS):
                own = (texts[at].as_py() or "").encode().split()  # at the six white space bytes, as the pattern does
                words.append(widened(own, ids[at]) if widen else own)
                units += [codes.setdefault(w, len(codes)) for w in words[-1]]
                first.append(len(units))
                at += 1
            yield _rows(ids[begin:at], words, np.array(units, dtype=np.int64), np.array(first))
    arrays.give_back()


def _rows(ids: list, words: list[list[bytes]], units: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    doc, start, length, period = runs(units, first)
    edges = np.searchsorted(doc, np.arange(len(ids) + 1))
    columns: list[list] = [[] for _ in range(7)]
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        s, n, q = (v[low:high].tolist() for v in (start, length, period))
        best = highest(s, n, q)
        kept = words[k]
        if s:
            gone = np.zeros(len(kept) + 1, dtype=np.int64)
            np.add.at(gone, start[low:high] + period[low:high], 1)
            np.add.at(gone, start[low:high] + length[low:high], -1)
            kept = [kept[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        found = (None,) * 4 if best is None else (s[best], n[best], q[best], 1000 * n[best] // q[best])
        for column, value in zip(columns, (len(s), *found, "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, q)),
                                           b" ".join(kept).decode())):
            column.append(value)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                                      names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "kept_text"])


def periodic_runs(docs: DataFrame, widen: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, kept_text) for every row of `docs` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of at least LEAST words and EXPONENT of
    its smallest periods that cannot be extended. `start` to `exponent_milli` are those of the run with the
    greatest length / period (ties: smallest start, then period), null without runs. `runs` has a line
    `start,length,period` for every run, by start and period. `kept_text` are the words that no run contains
    after its first period, joined by a space. With `widen` one document in ten first gets a periodic tail
    (`widened`).

    Null, empty and white texts: no words, no runs, empty `kept_text`. A null doc_id is kept, and its text is
    not widened. Rows that repeat a doc_id are looked at one by one; a text is never split. No rows in, no
    rows out. Columns besides doc_id and text are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda batches: _described(batches, widen), SCHEMA)
