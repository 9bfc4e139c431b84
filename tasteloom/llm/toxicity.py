"""Toxicity: a weighted finite-state grammar over clauses.

Five transducers are composed into one machine. The lexicon turns words into symbols: insults in three bands
of strength, threats, targets, negations, words of reported speech. The negation transducer marks what
follows a negation closely, the report transducer what stands in reported speech, and the target and threat
transducers what is aimed at somebody before or after it. The machine reads clause by clause and counts the
readings of the clauses it matches; a document's score is the logistic function of the readings' weights.

The insult lexicon (words, and beginnings of words) and the weights are learned from labelled documents; the
weights stay close to stated ones where labels say little.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteloom.llm import arrays

THRESHOLD = 0.3
TRAIN_DOCUMENTS = 20_000  # labelled documents the model is fitted on
LEXICON = 20_000  # learned entries, the most significant ones
LEAST_EVIDENCE = 18.0  # log-likelihood ratio of a learned entry
BANDS = (1.5, 3.0, 4.5)  # log odds from which an entry is a weak, a clear, a strong insult
STEMS = range(4, 10)  # letters of a learned beginning of longer words
SCOPE = 4  # words after a negation, or between an insult and its target
PENALTY = 0.5  # of the squared distance to the stated weights

# Words of the fixed lexicons in English, German, French and Spanish (fixed values).
INSULTS = """idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown fool liar jerk
    dumb imbecile filthy vermin dummkopf trottel arschloch abschaum versager idiotisch widerlich crétin imbécile salaud
    ordure minable dégoûtant idiota imbécil estúpido estúpida basura escoria asqueroso patético""".split()
THREATS = """kill kills hurt destroy shoot stab strangle murder töten umbringen vernichten erschießen erwürgen tuer frapper
    détruire étrangler matar golpear destruir estrangular asesinar""".split()
TARGETS = """you your yours yourself u ur they them these those du dich dir dein deine deinen euch ihr tu toi ton vous votre
    vos tú ti usted ustedes vosotros tus""".split()
NEGATIONS = """not no never nobody none neither nor don doesn didn isn aren wasn weren without nicht kein keine keinen nie
    niemals ohne ne pas jamais aucun aucune nunca jamás ningún sin tampoco""".split()
REPORTS = """said says say saying told tells called calls wrote writes quoted quotes claimed claims alleged sagte sagt nannte
    schrieb behauptete dit disait appelé écrit prétend dijo dice llamó escribió afirmó""".split()

OTHER, WEAK, CLEAR, STRONG, THREAT, TARGET, NEGATION, REPORT, END = range(9)
HARMFUL = (WEAK, CLEAR, STRONG, THREAT)

# Readings, and the weights they have before any label is seen.
READINGS = {("plain", WEAK): 0.3, ("plain", CLEAR): 1.0, ("plain", STRONG): 2.0, ("plain", THREAT): 0.5,
            ("aimed", WEAK): 0.6, ("aimed", CLEAR): 1.8, ("aimed", STRONG): 3.0, ("aimed", THREAT): 2.0,
            ("negated", WEAK): 0.0, ("negated", CLEAR): 0.2, ("negated", STRONG): 0.5, ("negated", THREAT): 0.0,
            ("reported", WEAK): 0.0, ("reported", CLEAR): 0.3, ("reported", STRONG): 0.6, ("reported", THREAT): 0.2}
DENSITY, BIAS = 1.0, -2.5
FEATURES = len(READINGS) + 2


@dataclass
class Transducer:
    """A deterministic transducer: `step(state, symbol)` gives the next state and what is written."""
    start: object
    step: Callable[[object, object], tuple[object, tuple]]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that passes what `first` writes on to `second`."""
    def step(state, symbol):
        one, two = state
        one, between = first.step(one, symbol)
        written = []
        for s in between:
            two, out = second.step(two, s)
            written += out
        return (one, two), tuple(written)
    return Transducer((first.start, second.start), step)


# Between the machines a word is a symbol; a pair is a reading of a word, written beside it, and takes no place.

def negations() -> Transducer:
    """Reads harmful symbols in the scope of a negation as negated."""
    def step(left, symbol):
        if symbol == END:
            return 0, (END,)
        if symbol == NEGATION:
            return SCOPE, (NEGATION,)
        return max(0, left - 1), ((("negated", symbol), OTHER) if left and symbol in HARMFUL else (symbol,))
    return Transducer(0, step)


def reports() -> Transducer:
    """Reads harmful symbols after a word of reported speech in the same clause as reported."""
    def step(inside, symbol):
        if symbol == END:
            return False, (END,)
        return inside or symbol == REPORT, ((("reported", symbol), OTHER) if inside and symbol in HARMFUL else (symbol,))
    return Transducer(False, step)


def targets(kinds: tuple) -> Transducer:
    """Reads symbols of `kinds` that have a target at most SCOPE words before or after them as aimed, others
    as plain.

    A symbol without a target before it waits until a target comes, the scope is left, the clause ends, or
    another one takes its place.
    """
    def step(state, symbol):
        near, waiting, left = state
        plain = (("plain", waiting),) if waiting is not None else ()
        if symbol == END:
            return (0, None, 0), (*plain, END)
        if isinstance(symbol, tuple):
            return state, (symbol,)
        if symbol == TARGET:
            return (SCOPE + 1, None, 0), ((("aimed", waiting),) if waiting is not None else ()) + (TARGET,)
        near = max(0, near - 1)
        if symbol in kinds:
            if near:
                return (near, None, 0), (*plain, ("aimed", symbol), OTHER)
            return (0, symbol, SCOPE), (*plain, OTHER)
        if waiting is not None and left <= 1:
            return (near, None, 0), (*plain, symbol)
        return (near, waiting, max(0, left - 1)), (symbol,)
    return Transducer((0, None, 0), step)


def readings() -> Transducer:
    """Writes the numbers of readings and nothing else."""
    number = {reading: k for k, reading in enumerate(READINGS)}
    return Transducer(None, lambda state, symbol: (state, (number[symbol],) if symbol in number else ()))


def compiled(machine: Transducer) -> list[list[tuple[int, tuple]]]:
    """table[state][symbol] = (next state, readings), for all states that can be reached; 0 is the start."""
    known, table = {machine.start: 0}, []
    todo = [machine.start]
    for state in todo:
        row = []
        for symbol in range(END + 1):
            after, out = machine.step(state, symbol)
            if after not in known:
                known[after] = len(known)
                todo.append(after)
            row.append((known[after], out))
        table.append(row)
    return table


def grammar() -> list[list[tuple[int, tuple]]]:
    """Insults are aimed by the first target transducer and threats by the second one."""
    machine = compose(compose(compose(compose(negations(), reports()), targets((WEAK, CLEAR, STRONG))), targets((THREAT,))), readings())
    return compiled(machine)


# ---------------------------------------------------------------- words

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True
_ENDS_CLAUSE = np.zeros(256, dtype=bool)
_ENDS_CLAUSE[[ord(c) for c in ".!?;:\n"]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and U+00C0 to U+00DE (but the multiplication sign) in lower case."""
    out = arrays.LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[after] += 0x20
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the runs of letters; no run goes beyond its document."""
    inside = _IS_LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[(offsets >= 0) & (offsets <= len(data))]] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Lexicon:
    """Symbols of words by the hashes of whole words and of beginnings of a given number of bytes."""

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.words = self._sorted(words)
        by_size: dict[int, dict[str, int]] = {}
        for stem, symbol in stems.items():
            by_size.setdefault(len(stem.encode()), {})[stem] = symbol
        self.stems = {size: self._sorted(part) for size, part in sorted(by_size.items())}

    @staticmethod
    def _sorted(entries: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, symbols, which of the first 20 bits of a hash occur)."""
        codes = np.array([_code(e.encode()) for e in entries], dtype=np.uint64)
        order = np.argsort(codes)
        seen = np.zeros(1 << 20, dtype=bool)
        seen[codes >> np.uint64(44)] = True
        return codes[order], np.array(list(entries.values()), dtype=np.uint8)[order], seen

    @staticmethod
    def _look(codes: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known codes, their symbols)."""
        known, symbols, seen = table
        maybe = np.flatnonzero(seen[codes >> np.uint64(44)])
        if not len(maybe):
            return maybe, np.zeros(0, dtype=np.uint8)
        at = np.minimum(np.searchsorted(known, codes[maybe]), len(known) - 1)
        ok = known[at] == codes[maybe]
        return maybe[ok], symbols[at[ok]]

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each word of lower-case bytes: a known word's own, else that of its strongest beginning."""
        out = np.zeros(len(starts), dtype=np.uint8)
        if not len(starts):
            return out
        sums = arrays.prefix_sums(arrays.BYTE_CODE[data])
        for size, table in self.stems.items():
            longer = np.flatnonzero(ends - starts > size)
            at, found = self._look(arrays.span_hash(sums, starts[longer], starts[longer] + size), table)
            out[longer[at]] = np.maximum(out[longer[at]], found)
        at, found = self._look(arrays.span_hash(sums, starts, ends), self.words)
        out[at] = found
        return out


def _code(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(arrays.span_hash(arrays.prefix_sums(arrays.BYTE_CODE[data]), np.array([0]), np.array([len(data)]))[0])


# ---------------------------------------------------------------- features and model

def clause_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, table: list) -> np.ndarray:
    """A row per document: log(1 + clauses with it) of each reading, the density of harmful words, and one."""
    out = np.zeros((len(offsets) - 1, FEATURES))
    out[:, -1] = 1.0
    low = lowered(data)
    starts, ends, doc = word_spans(data, offsets)
    symbols = lexicon.symbols(low, starts, ends)
    harmful = np.flatnonzero((symbols >= WEAK) & (symbols <= THREAT))
    if not len(harmful):
        return out
    marks = np.concatenate([[0], np.cumsum(_ENDS_CLAUSE[data])])
    clause = marks[starts] + doc  # a document's end is one more mark
    for number in np.unique(clause[harmful]):
        a, b = np.searchsorted(clause, [number, number + 1])
        state, found = 0, set()
        for symbol in symbols[a:b].tolist() + [END]:
            state, written = table[state][symbol]
            found.update(written)
        out[doc[a], sorted(found)] += 1
    out[:, :-2] = np.log1p(out[:, :-2])
    words = np.bincount(doc, minlength=len(out))
    out[:, -2] = np.minimum(1.0, 20 * np.bincount(doc[harmful], minlength=len(out)) / np.maximum(words, 1))
    return out


class Model:
    """A lexicon and the weights of the readings."""

    def __init__(self, words: dict[str, int] | None = None, stems: dict[str, int] | None = None):
        fixed = {w: s for s, group in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (CLEAR, INSULTS))
                 for w in group}
        self.lexicon = Lexicon(fixed | (words or {}), stems or {})
        self.table = grammar()
        self.stated = np.array([*READINGS.values(), DENSITY, BIAS])
        self.weights = self.stated.copy()

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        parts = [clause_features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], self.lexicon, self.table)
                 for a, b in arrays.slices(offsets)]
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))

    def fit(self, features: np.ndarray, labels: np.ndarray) -> "Model":
        """Newton's method on the log loss plus PENALTY times the squared distance to the stated weights."""
        for _ in range(50 if len(labels) else 0):
            p = self.scores(features)
            gradient = features.T @ (p - labels) + 2 * PENALTY * (self.weights - self.stated)
            curve = (features * (p * (1 - p))[:, None]).T @ features + 2 * PENALTY * np.eye(FEATURES)
            step = np.linalg.solve(curve, gradient)
            self.weights = self.weights - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        return self


def held_out(doc_id):
    """Documents that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def forms(word: str) -> list[str]:
    """Lexicon entries that cover a word: itself, and its beginnings, which end in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, toxic, clean): documents that have it."""
    for batch in batches:
        found = (Counter(), Counter())
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            data, offsets = arrays.flat(pa.array([text.as_py()], pa.string()))
            starts, ends, _ = word_spans(data, offsets)
            low = lowered(data).tobytes()
            words = {low[a:b] for a, b in zip(starts.tolist(), ends.tolist())}
            found[1 - toxic].update({f for w in words for f in forms(w.decode("utf-8", "ignore"))})
        keys = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in found]],
                                         names=["form", "toxic", "clean"])


def learned_entries(sample: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """(words, beginnings) and their bands, from `sample` (text, toxic): entries whose documents are toxic
    clearly more often than others are. A fixed insult that the labels contradict is no insult.

    Counts are added up in Spark; at most LEXICON entries, and one count for each fixed word, reach the driver.
    """
    size = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = size["t"] or 0, size["c"] or 0
    if not toxic or not clean:
        return {}, {}
    counts = sample.mapInArrow(_counted, "form string, toxic long, clean long").groupBy("form").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share = (F.col("t") + F.col("c")) / F.lit(float(toxic + clean))

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    scored = counts.withColumn("odds", odds).withColumn(
        "evidence", 2 * (part(F.col("t"), share * toxic) + part(F.col("c"), share * clean)))
    rows = scored.where((F.col("odds") >= BANDS[0]) & (F.col("evidence") >= LEAST_EVIDENCE)).orderBy(
        F.desc("evidence"), "form").limit(LEXICON).collect()
    words, stems = {}, {}
    for r in rows:
        band = (WEAK, CLEAR, STRONG)[sum(r["odds"] >= b for b in BANDS) - 1]
        (stems if r["form"].endswith("*") else words)[r["form"].removesuffix("*")] = band
    doubted = scored.where(F.col("form").isin(INSULTS) & (F.col("odds") < 0) & (F.col("evidence") >= LEAST_EVIDENCE))
    return words | {r["form"]: OTHER for r in doubted.collect()}, stems


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model:
    """A model of `labels.toxic` from `documents` labelled documents picked by a hash of their id, none of
    them held out. Equal texts count once in the lexicon. The sample's features, a short row each, come to
    the driver. Without labels the stated lexicon and weights are the model."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(known), "doc_id").select("text", "toxic")
    once = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    model = Model(*learned_entries(once))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = model.features(*arrays.flat(batch.column("text"))).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             names=["toxic", "features"])
    rows = sorted((r["features"], r["toxic"]) for r in sample.mapInArrow(task, "toxic int, features binary").collect())
    matrix = np.array([np.frombuffer(f, "<f8") for f, _ in rows]).reshape(-1, FEATURES)
    return model.fit(matrix, np.array([float(y) for _, y in rows]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text).

    The model comes from `train`; `predicted` is 1 from a score of THRESHOLD on. Null and empty texts have no
    clause and get the score of harmless ones. Rows that repeat a doc_id are scored one by one. A null doc_id
    is scored, `held_out` is null. Empty `labels`: stated lexicon and weights. No rows in, no rows out. Other
    columns are not looked at.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(model.features(*arrays.flat(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])
    return rows.mapInArrow(task, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
