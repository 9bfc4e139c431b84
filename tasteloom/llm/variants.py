"""Spelling variants: words one inserted, deleted or replaced letter apart, found in a trie of letter counts.

Letters fall into GROUPS groups. A word is a path of counts: its length, then how many letters of each group
it has. One edit raises at most one count by one (a surplus) and lowers at most one by one (a deficit), so a
depth-first search that may spend one of each, and nothing else, meets every near word at a leaf. Leaf words
are verified letter by letter.

The top of the trie is dealt out by Spark: a node is a length and the first few counts, as many as keep the
largest node below NODE_WORDS words, and a word is sent to each node its budget can reach. The rest of a
node's trie is built and searched in one task, by arrays of words rather than word by word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteloom.llm import arrays
from tasteloom.session import write_once

LEAST_LETTERS = 5
LEAST_COUNT = 3
EVERY = 97  # one run in so many loses a letter
DOMINANCE = 2  # a form is at least so many times as frequent
GROUPS = 12
NODE_WORDS = 20_000  # of a node of the dealt top
COUNTED_WORDS = 200_000  # different words a task counts before it passes them on
PAIRS = 1 << 19  # candidates verified at a time

# In UTF-8 the letters U+00C0 to U+00FF are the byte C3 and one of 80 to BF. Only A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
FIELDS = "node binary, surplus int, deficit int, visitor boolean, word string"


def without_one(run: bytes, code: int) -> bytes:
    """The run without its code point number `code` modulo its length."""
    letters = run.decode()
    at = code % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def passed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            own = doc_id.as_py()
            runs = _RUN.findall((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER))
            found.update(runs)
            start = zlib.crc32(f"{'' if own is None else own}:".encode())
            for run in runs:
                code = zlib.crc32(run, start)
                if code % EVERY == 0:
                    found[run] -= 1
                    found[without_one(run, code)] += 1
            if len(found) > COUNTED_WORDS:
                yield passed_on()
                found = Counter()
    yield passed_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of `docs` (doc_id, text) with at least LEAST_LETTERS code points and LEAST_COUNT occurrences."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long").where(F.length("word") >= LEAST_LETTERS)
    return write_once(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "vocabulary")


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, offsets): every letter is one Latin-1 byte."""
    data = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])


def paths(words: list[str]) -> np.ndarray:
    """A row per word: its length and its letters in each group."""
    data, offsets = letters(words)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(owner * GROUPS + data % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return np.hstack([sizes[:, None], counts]).astype(np.int64)


def _with_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = paths(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * (GROUPS + 1), pa.int32()),
                                                            pa.array(found.ravel(), pa.int32()))], names=["word", "path"])


def depth(words: DataFrame) -> int:
    """Counts that a node of the dealt top has beside the length: the fewest with which no node of `words`
    (word, path) has more than NODE_WORDS words, all of them if none does."""
    for size in range(1, GROUPS + 1):
        most = words.groupBy(F.slice("path", 1, size + 1)).count().agg(F.max("count")).first()[0] or 0
        if most <= NODE_WORDS:
            return size
    return GROUPS


def visits(size: int) -> list[tuple[np.ndarray, int, int]]:
    """(change of the path's head, surplus left, deficit left): the nodes a word has to be looked up in.

    A pair is found from one side only: from the shorter word, and of equally long ones from the one whose
    path comes first. So in a path of the same length the surplus is spent before the deficit.
    """
    def change(length: int, *steps: tuple[int, int]) -> np.ndarray:
        out = np.zeros(size + 1, dtype=np.int64)
        out[0] = length
        for at, by in steps:
            out[at + 1] = by
        return out
    found = [(change(0), 1, 1), (change(1), 1, 0)]
    for up in range(size):
        found += [(change(0, (up, 1)), 0, 1), (change(1, (up, 1)), 0, 0)]
        found += [(change(0, (up, 1), (down, -1)), 0, 0) for down in range(up + 1, size)]
    return found


def _sent(size: int):
    where = visits(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("path")
            heads = column.flatten().to_numpy().reshape(-1, GROUPS + 1)[:, :size + 1].astype(np.int64)

            def rows(nodes: np.ndarray, keep: np.ndarray, surplus: int, deficit: int, visitor: bool) -> pa.RecordBatch:
                raw = nodes[keep].astype(">u4").tobytes()
                width, count = 4 * (size + 1), int(keep.sum())
                node = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(
                    (np.arange(count + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                return pa.RecordBatch.from_arrays(
                    [node, pa.array(np.full(count, surplus, np.int32)), pa.array(np.full(count, deficit, np.int32)),
                     pa.array(np.full(count, visitor)), batch.column("word").filter(pa.array(keep))],
                    names=["node", "surplus", "deficit", "visitor", "word"])
            yield rows(heads, np.ones(len(heads), dtype=bool), 0, 0, False)
            for by, surplus, deficit in where:
                nodes = heads + by
                yield rows(nodes, (nodes >= 0).all(axis=1), surplus, deficit, True)
    return run


class Trie:
    """The words of one node, which are equally long, by the counts that the node leaves open."""

    def __init__(self, words: list[str], size: int):
        found = paths(words)[:, size + 1:]
        order = np.lexsort(found.T[::-1]) if found.shape[1] else np.arange(len(words))
        self.size, self.words, counts = size, [words[k] for k in order], found[order]
        self.width = int(counts.max(initial=0)) + 2  # of a level's keys; a visitor may have one letter more
        self.levels = []
        ids = np.zeros(len(words), dtype=np.int64)
        for level in range(counts.shape[1]):
            keys = ids * self.width + counts[:, level]
            new = np.r_[True, keys[1:] != keys[:-1]]
            self.levels.append(keys[new])
            ids = np.cumsum(new) - 1
        self.leaves = np.append(np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(words))
        length = len(words[0])
        self.matrix = letters(self.words)[0].reshape(-1, length)
        m = length - 1
        self.same = self.halves(self.matrix, length // 2, length // 2)
        self.longer = self.halves(self.matrix, m // 2, m // 2 + 1)

    @staticmethod
    def halves(matrix: np.ndarray, head: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the letters before `head` and from `tail` on."""
        def code(part):
            return (arrays.BYTE_CODE[part] * arrays.powers(arrays.BASE, part.shape[1])).sum(axis=1, dtype=np.uint64)
        return code(matrix[:, :head]), code(matrix[:, tail:])

    def near(self, words: list[str], surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(of `words`, of the trie): numbers of words one edit apart, reached with that budget."""
        counts = paths(words)[:, self.size + 1:]
        length = len(words[0])
        matrix = letters(words)[0].reshape(-1, length)
        same = length == self.matrix.shape[1]
        own = self.halves(matrix, length // 2, length // 2)
        # Words next to each other are a block, so that the pairs in memory are bounded.
        start = np.zeros(len(words), dtype=np.int64)
        for visitors, leaves, unspent in self.search(counts, 0, np.arange(len(words)), start, surplus, deficit):
            number = self.leaves[leaves + 1] - self.leaves[leaves]
            ends = np.cumsum(number)
            low = 0
            while low < len(visitors):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
                some = number[low:high]
                a = np.repeat(visitors[low:high], some)
                b = np.arange(some.sum()) + np.repeat(self.leaves[leaves[low:high]] - (np.cumsum(some) - some), some)
                a, b = self.verified(a, b, matrix, own, same)
                if unspent and same:  # equal paths meet from both sides
                    once = np.array([words[x] < self.words[y] for x, y in zip(a, b)], dtype=bool)
                    a, b = a[once], b[once]
                yield a, b
                low = high

    def search(self, counts: np.ndarray, level: int, visitors: np.ndarray, nodes: np.ndarray, surplus: int, deficit: int):
        """Depth-first, for many words at once: (visitors, leaves, whether nothing was spent) of every way to
        spend the budget."""
        if level == len(self.levels):
            yield visitors, nodes, bool(surplus and deficit)
            return
        steps = [(0, surplus, deficit)] + ([(1, 0, deficit)] if surplus else [])
        if deficit and not surplus:
            steps.append((-1, 0, 0))
        keys = self.levels[level]
        for by, more, less in steps:
            value = counts[visitors, level] + by
            wanted = nodes * self.width + value
            at = np.searchsorted(keys, wanted)
            ok = (value >= 0) & (value < self.width) & (keys[np.minimum(at, len(keys) - 1)] == wanted)
            if ok.any():
                yield from self.search(counts, level + 1, visitors[ok], at[ok], more, less)

    def verified(self, a: np.ndarray, b: np.ndarray, matrix: np.ndarray, own: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are exactly one edit apart; one edit leaves the first or the last half of a word alone."""
        theirs = self.same if same else self.longer
        keep = (own[0][a] == theirs[0][b]) | (own[1][a] == theirs[1][b])
        a, b = a[keep], b[keep]
        out = np.zeros(len(a), dtype=bool)
        step = max(1, (1 << 22) // matrix.shape[1])
        for low in range(0, len(a), step):
            x, y = matrix[a[low:low + step]], self.matrix[b[low:low + step]]
            if same:
                out[low:low + step] = (x != y).sum(axis=1) == 1
            else:
                front, back = x != y[:, :-1], (x != y[:, 1:])[:, ::-1]
                equal = [np.where(d.any(axis=1), d.argmax(axis=1), d.shape[1]) for d in (front, back)]
                out[low:low + step] = equal[0] + equal[1] >= x.shape[1]
        return a[out], b[out]


def _searched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, trie = None, [], None
        for batch in batches:
            words, nodes = batch.column("word").to_pylist(), batch.column("node").to_pylist()
            kinds = list(zip(nodes, batch.column("visitor").to_pylist(), batch.column("surplus").to_pylist(),
                             batch.column("deficit").to_pylist()))
            heads = [k for k in range(len(kinds)) if not k or kinds[k] != kinds[k - 1]] + [len(kinds)]
            left, right = [], []
            for low, high in zip(heads, heads[1:]):
                node, visitor, surplus, deficit = kinds[low]
                if node != current:
                    current, held, trie = node, [], None
                if not visitor:
                    held += words[low:high]
                    continue
                if not held:
                    continue
                trie = trie or Trie(held, size)
                part = words[low:high]
                by_length: dict[int, list[str]] = {}
                for w in part:
                    by_length.setdefault(len(w), []).append(w)
                for same in by_length.values():
                    for a, b in trie.near(same, surplus, deficit):
                        left += [same[k] for k in a]
                        right += [trie.words[k] for k in b]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])
        arrays.give_back()
    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): every pair of words of `words` (word) that are one edit apart, in one of its directions, written."""
    placed = write_once(words.select("word").mapInArrow(_with_path, "word string, path array<int>"), "paths")
    size = depth(placed)
    sent = placed.mapInArrow(_sent(size), FIELDS)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sent.repartition(parts, "node").sortWithinPartitions("node", "visitor", "surplus", "deficit")
    return write_once(dealt.mapInArrow(_searched(size), "a string, b string"), "near-words")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary of `docs` (doc_id, text).

    Words are maximal runs of `[A-Za-z\\u00C0-\\u00FF]` with A-Z in lower case. Let h be the crc32 of
    `<doc_id>:<run>`; where EVERY divides h the run loses its code point h % length. The vocabulary has the
    results with at least LEAST_LETTERS code points and LEAST_COUNT occurrences. `form` is the most frequent
    near word (ties: the smallest) if it is at least DOMINANCE times as frequent; `root` is the last of the
    forms from a word on, the word itself if it has none.

    Null and empty texts have no words. A null doc_id counts as an empty text before the colon. Rows that
    repeat a doc_id or a text count one by one. Words may be as long as a text. No rows in, no rows out.
    Columns besides doc_id and text are not looked at.
    """
    words = vocabulary(docs)
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("most"),
                                    F.min(F.struct(-F.col("near_n"), F.col("b"))).alias("first"))
    known = words.join(best, F.col("word") == F.col("a"), "left")
    chosen = F.col("most") >= DOMINANCE * F.col("n")
    found = write_once(known.select(
        "word", F.when(chosen, F.col("first.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("most")).alias("form_n")), "forms")
    roots = roots_of(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles. Every round doubles the way that has been gone, so
    there are as many rounds as the longest chain has binary digits; a form is at least twice as frequent."""
    known = write_once(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while known.where("open").limit(1).count():
        after = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = write_once(known.join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
    return known.select("word", "root")
