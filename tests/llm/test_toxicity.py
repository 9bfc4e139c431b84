import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from fixtures import frame, hard_rows, sentence

import __spark_entry__ as driver
from tasteloom.llm import arrays, toxicity
from tasteloom.llm.toxicity import CLEAR, END, HARMFUL, NEGATION, OTHER, REPORT, SCOPE, TARGET, THREAT, WEAK


def brute(clause):
    """The readings of a clause by their definition, without transducers."""
    marked = []
    for k, s in enumerate(clause):
        if s in HARMFUL and NEGATION in clause[max(0, k - SCOPE):k]:
            marked.append(("negated", s))
        elif s in HARMFUL and REPORT in clause[:k]:
            marked.append(("reported", s))
        else:
            marked.append(s)
    found = set()
    for k, s in enumerate(marked):
        if isinstance(s, tuple):
            found.add(s)
        elif s in HARMFUL:
            same = (THREAT,) if s == THREAT else tuple(h for h in HARMFUL if h != THREAT)
            before = any(marked[j] == TARGET for j in range(max(0, k - SCOPE), k))
            after = False
            for j in range(k + 1, min(len(marked), k + 1 + SCOPE)):
                if marked[j] == TARGET:
                    after = True
                if marked[j] == TARGET or marked[j] in same:
                    break
            found.add(("aimed" if before or after else "plain", s))
    return found


def read(table, clause):
    names, state, found = list(toxicity.READINGS), 0, set()
    for symbol in [*clause, END]:
        state, written = table[state][symbol]
        found |= {names[k] for k in written}
    return found, state


@pytest.mark.parametrize("clause, reading", [
    ([CLEAR], ("plain", CLEAR)), ([TARGET, OTHER, CLEAR], ("aimed", CLEAR)), ([CLEAR, OTHER, OTHER, TARGET], ("aimed", CLEAR)),
    ([TARGET, NEGATION, OTHER, CLEAR], ("negated", CLEAR)), ([OTHER, REPORT, TARGET, CLEAR], ("reported", CLEAR)),
    ([OTHER, THREAT, TARGET], ("aimed", THREAT)), ([CLEAR] + [OTHER] * 9 + [TARGET], ("plain", CLEAR))])
def test_readings(clause, reading):
    assert read(toxicity.grammar(), clause)[0] == {reading}


def test_the_machine_reads_random_clauses_as_defined():
    table, r = toxicity.grammar(), random.Random(1)
    for _ in range(5000):
        clause = [r.choice([OTHER, OTHER, OTHER, WEAK, CLEAR, THREAT, TARGET, NEGATION, REPORT]) for _ in range(r.randint(0, 14))]
        got, state = read(table, clause)
        assert got == brute(clause) and state == 0, clause


def features(model, texts):
    return model.features(*arrays.flat(pa.array(texts, pa.string())))


def test_clauses_not_words_count():
    model = toxicity.Model()
    aimed, denied, said, none = model.scores(features(model, [
        "You are an IDIOT!", "You are not an idiot.", "The report says you are an idiot.", "You are here. Nobody else is."]))
    assert aimed > toxicity.THRESHOLD > max(denied, said, none) and none <= min(denied, said)
    # A negation in another clause says nothing.
    assert model.scores(features(model, ["No. You are an idiot!"]))[0] > toxicity.THRESHOLD
    assert (model.scores(features(model, ["DÉGOÛTANT, toi", "Du Trottel", "vamos a matar ahora a ti"])) > toxicity.THRESHOLD).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = driver.queries()["op13_toxicity_grammar"](spark, folder).collect()
    labels = dict(duckdb.connect().execute(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall())
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(held) > 900
    caught = [r.predicted for r in held if labels[r.doc_id]]
    spared = [1 - r.predicted for r in held if not labels[r.doc_id]]
    assert np.mean(caught) > 0.9 and np.mean(spared) > 0.99


def test_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(9, 0, 0), (10, 1, 0), (10, 1, 0), (None, 1, 1), (12, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(hard, labels).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in rows) == sorted((i is not None, i) for i, _ in hard_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and (r.held_out is None) == (r.doc_id is None) for r in rows)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity_scores(hard, labels.limit(0)).collect()} == {0}


def test_words_and_stems_are_learned_from_labels(spark):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        text = sentence(r, 60)
        if k % 4 == 0:
            text += f". zorkling{r.choice('abcdef')} " + r.choice(["blarg", "BLARG", "x blarg"]) + " you"
        rows.append((k, text + (" idiot" if k % 4 else "")))
        labels.append((k, 1, int(k % 4 == 0)))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    words, stems = toxicity.learned_entries(docs.join(known.select("doc_id", "toxic"), "doc_id").select("text", "toxic"))
    assert words["blarg"] == toxicity.STRONG and "zork" in stems and words["idiot"] == OTHER
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in toxicity.toxicity_scores(docs, known).collect())


def test_long_clause_and_words_at_the_edges_of_texts():
    model = toxicity.Model()
    long = "word " * 50_000
    got = features(model, [None, "", "idiot", "s", long + "you idiot " + long, "ÉTÉ stupid###", "stup", "id"])
    assert (got[[0, 1, 3, 6, 7], :-1] == 0).all() and (got[[2, 4, 5], :-2].sum(axis=1) > 0).all()
