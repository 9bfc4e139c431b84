import duckdb
import numpy as np
from fixtures import frame, hard_rows
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tasteloom.llm import arrays, quality

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in driver.queries()["op7_quality_classifier"](spark, FOLDER).collect()}
    labels = duckdb.connect().execute(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall()
    out = [(rows[i].predicted, q, rows[i].score) for i, q in labels if rows[i].held_out]
    assert len(out) > 500 and np.mean([p == q for p, q, _ in out]) > 0.97
    good, bad = [[s for _, q, s in out if q == k] for k in (1, 0)]
    assert np.mean([g > b for g in good for b in bad]) > 0.99  # area under the curve
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_scores_depend_on_training_labels_and_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = quality.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    a, b = (sorted(map(tuple, quality.quality_scores(d, l).collect())) for d, l in ((docs, labels), (other, flipped)))
    assert a == b


def test_gradients():
    random = np.random.default_rng(0)
    model = quality.AttentionModel()
    x, heads, label = random.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])

    def loss():
        score = model._forward(x, heads)["score"]
        return -np.mean(label * np.log(score) + (1 - label) * np.log(1 - score))
    found = model._gradients(x, heads, label)
    for name, weight in model.weights.items():
        weight += random.normal(size=weight.shape) * 0.1
    found = model._gradients(x, heads, label)
    for name, weight in model.weights.items():
        for at in list(np.ndindex(weight.shape))[:5]:
            weight[at] += 1e-5
            up = loss()
            weight[at] -= 2e-5
            assert abs((up - loss()) / 2e-5 - found[name][at]) < 1e-6
            weight[at] += 1e-5


def test_attention_finds_the_bad_passage():
    """Bags of good passages, some with one bad passage: the bag score follows it."""
    random = np.random.default_rng(1)
    bags, labels = [], []
    for k in range(400):
        bag = random.normal(size=(12, quality.FEATURES))
        if k % 2:
            bag[random.integers(12), :6] += 4
        bags.append(bag)
        labels.append(float(k % 2))
    model = quality.AttentionModel().fit(bags[:300], np.array(labels[:300]))
    scores = np.concatenate([model.scores(b, np.zeros(len(b), dtype=int), 1) for b in bags[300:]])
    assert np.mean((scores > 0.5) == np.array(labels[300:])) > 0.9


def test_passages_cover_long_texts(monkeypatch):
    text = " ".join(f"word{k}" for k in range(10_000)).encode()
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, 0, len(text)])
    docs, rows = quality.passage_features(data, offsets)
    assert np.bincount(docs).tolist() == [1, -(-10_000 // 64)] and rows.shape[1] == quality.FEATURES
    monkeypatch.setattr(arrays, "SLICE", 5000)
    docs, rows = quality.passage_features(data, offsets)
    assert docs[0] == 0 and (docs[1:] == 1).all() and len(docs) >= 158


def test_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, 0), (11, 1, 1), (11, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(hard, labels).collect()
    assert len(rows) == len(hard_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1  # null, empty and white texts
    kept = quality.accepted(hard, labels)
    assert kept.schema.names == hard.schema.names
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(hard, none).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0
    clash = frame(spark, [(1, "a b c")])
    assert quality.accepted(clash, none).collect() == clash.collect()
