"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention weighs the passages, and the
weighted sum is scored; all of it is learned from labels of whole documents (Ilse, Tomczak, Welling:
Attention-based Deep Multiple Instance Learning). Training uses a bounded sample of labelled
documents; scoring runs over whole texts in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteloom.llm import arrays

PASSAGE_WORDS = 64
THRESHOLD = 0.3
TRAIN_DOCUMENTS = 3000  # labelled documents the model is fitted on
TRAIN_PASSAGES = 64  # of a training document, evenly spaced; scoring uses all
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4

# Bytes fall into a class each for the printable ASCII characters but letters, and one each for lower
# and upper case, control characters and bytes of other characters.
_CLASS = np.full(256, 1, dtype=np.int64)
_CLASS[:32] = 0
_CLASS[127] = 0
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_OTHERS = [b for b in range(32, 127) if not (65 <= b < 91 or 97 <= b < 123)]
_CLASS[_OTHERS] = np.arange(4, 4 + len(_OTHERS))
CLASSES = 4 + len(_OTHERS)
FEATURES = CLASSES + 8


def _passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, features) of the passages of some texts; a text without words is one passage."""
    starts, ends, first = arrays.word_places(data, offsets)
    counts = np.diff(first)
    numbers = np.maximum(1, -(-counts // PASSAGE_WORDS))
    docs = np.repeat(np.arange(len(counts)), numbers)
    base = np.cumsum(numbers) - numbers
    words_doc = np.repeat(np.arange(len(counts)), counts)
    local = np.arange(len(starts)) - first[words_doc]
    passage = base[words_doc] + local // PASSAGE_WORDS
    out = np.zeros((len(docs), FEATURES))
    if not len(starts):
        return docs, out
    total = len(docs)
    n = np.bincount(passage, minlength=total)
    lengths = ends - starts
    # The bytes from a passage's first word up to the end of its last one.
    heads = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    tails = np.append(heads[1:], len(starts)) - 1
    sizes = ends[tails] - starts[heads]
    places = np.arange(sizes.sum()) + np.repeat(starts[heads] - (np.cumsum(sizes) - sizes), sizes)
    owner = np.repeat(passage[heads], sizes)
    histogram = np.bincount(owner * CLASSES + _CLASS[data[places]], minlength=total * CLASSES).reshape(total, CLASSES)
    out[:, :CLASSES] = np.sqrt(histogram / np.maximum(histogram.sum(axis=1, keepdims=True), 1))
    codes = arrays.mixed(arrays.span_hash(arrays.prefix_sums(arrays.BYTE_CODE[data]), starts, ends))
    order = np.lexsort((codes, passage))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
    last = data[ends - 1]
    many = np.maximum(n, 1)

    def mean(values):
        return np.bincount(passage, values, minlength=total) / many
    out[:, CLASSES:] = np.stack([
        np.bincount(passage[order][fresh], minlength=total) / many, mean(again), mean(lengths) / 8,
        np.sqrt(mean(lengths.astype(float) ** 2)) / 8, mean(lengths <= 3), mean(lengths > 12),
        mean((last == 46) | (last == 44)), np.log1p(n) / 5], axis=1)
    return docs, out


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, features) of all passages of a batch, in order."""
    docs, rows = [np.zeros(0, dtype=np.int64)], [np.zeros((0, FEATURES))]
    for low, high in arrays.slices(offsets):
        part = data[offsets[low]:offsets[high]]
        if high - low == 1 and len(part) > 2 * arrays.SLICE:  # passages also end where a long text is cut
            for a, b in arrays.pieces(part, arrays.SLICE):
                own, found = _passages(part[a:b], np.array([0, b - a]))
                docs.append(own + low)
                rows.append(found)
        else:
            own, found = _passages(part, offsets[low:high + 1] - offsets[low])
            docs.append(own + low)
            rows.append(found)
    return np.concatenate(docs), np.concatenate(rows)


class AttentionModel:
    """Encoder, gated attention and scorer over bags of passages."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)

        def start(rows, columns):
            return random.normal(0, 1 / np.sqrt(rows), (rows, columns))
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights = {"W": start(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": start(HIDDEN, ATTENTION),
                        "U": start(HIDDEN, ATTENTION), "a": start(ATTENTION, 1), "c": np.zeros((HIDDEN, 1)), "d": np.zeros(1)}

    def _forward(self, x: np.ndarray, heads: np.ndarray) -> dict:
        w = self.weights
        sizes = np.diff(np.append(heads, len(x)))
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = ((v * u) @ w["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), sizes))
        weight = e / np.repeat(np.add.reduceat(e, heads), sizes)
        z = np.add.reduceat(h * weight[:, None], heads)
        logit = np.clip((z @ w["c"])[:, 0] + w["d"][0], -30, 30)
        return {"sizes": sizes, "h": h, "v": v, "u": u, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-logit))}

    def scores(self, x: np.ndarray, docs: np.ndarray, count: int) -> np.ndarray:
        """Score of each of `count` documents; every one has a passage."""
        heads = np.searchsorted(docs, np.arange(count))
        return self._forward((x - self.mean) / self.scale, heads)["score"] if count else np.zeros(0)

    def _gradients(self, x: np.ndarray, heads: np.ndarray, label: np.ndarray) -> dict:
        w, f = self.weights, self._forward(x, heads)
        error = (f["score"] - label)[:, None] / len(label)
        spread = np.repeat(error, f["sizes"], axis=0) @ w["c"].T  # of the bag vector, for each passage
        dweight = (spread * f["h"]).sum(axis=1)
        within = np.repeat(np.add.reduceat(dweight * f["weight"], heads), f["sizes"])
        de = (f["weight"] * (dweight - within))[:, None]
        gate = de @ w["a"].T
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = (spread * f["weight"][:, None] + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
                "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ error, "d": error.sum(axis=0)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> "AttentionModel":
        """Adam on the log loss, in mini-batches of documents."""
        if not len(bags):
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 0.05
        bags = [(b - self.mean) / self.scale for b in bags]
        random = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.weights.items()}
        two = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = random.permutation(len(bags))
            for low in range(0, len(order), BATCH):
                part = order[low:low + BATCH]
                sizes = np.array([len(bags[k]) for k in part])
                found = self._gradients(np.concatenate([bags[k] for k in part]), np.cumsum(sizes) - sizes, labels[part])
                step += 1
                for k, g in found.items():
                    g = g + DECAY * self.weights[k]
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (one[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def held_out(doc_id):
    """Documents that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> AttentionModel:
    """A model of `labels.quality`, fitted on `documents` labelled documents picked by a hash of their
    id, none of them held out. The sample's features, at most TRAIN_PASSAGES rows each, come to the
    driver; nothing else does. Without labels the model scores everything 0.5."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(
        F.broadcast(known), "doc_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = passage_features(*arrays.flat(batch.column("text")))
            edge = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            bags = []
            for low, high in zip(edge, edge[1:]):
                some = low + np.unique(np.linspace(0, high - low - 1, min(high - low, TRAIN_PASSAGES)).astype(int))
                bags.append(rows[some].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(bags, pa.binary())],
                                             names=["doc_id", "quality", "bag"])
    rows = picked.mapInArrow(task, "doc_id long, quality int, bag binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["bag"]))
    bags = [np.frombuffer(r["bag"], dtype="<f4").astype(float).reshape(-1, FEATURES) for r in rows]
    return AttentionModel().fit(bags, np.array([float(r["quality"]) for r in rows]))


def with_scores(docs: DataFrame, model: AttentionModel, text: str = "text") -> DataFrame:
    """`docs` with a last column `score`: 0 to 1, the higher the likelier is label 1. Nothing but the
    text is looked at; a null one counts as empty."""
    position = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = plain.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            data, offsets = arrays.flat(batch.column(f"c{position}"))
            for low, high in arrays.slices(offsets):
                owner, rows = passage_features(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                scores.append(model.scores(rows, owner, high - low))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                                             names=[*fields, "score"])
    schema = plain.withColumn("score", F.lit(0.0)).schema
    return plain.mapInArrow(task, schema).toDF(*docs.columns, "score")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text).

    The model comes from `train`; `predicted` is 1 from a score of THRESHOLD on. Null and empty texts
    are one passage without words and get its score. Rows that repeat a doc_id are scored one by one.
    A null doc_id is scored, `held_out` is null. Empty `labels`: every score is 0.5. No rows in, no
    rows out. Other columns are not looked at.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return with_scores(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents the classifier rejects; all columns stay as they are."""
    scored = with_scores(docs, train(docs, labels))
    return scored.toDF(*[f"c{i}" for i in range(len(docs.columns))], "score").where(
        F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)
