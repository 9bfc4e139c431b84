import random

import numpy as np

from helpers import values
from tasteloom.operators import encode, order, split
from tasteloom.sources import files
from tasteloom.session import new_path


def test_labels_are_numbered_in_text_order(spark):
    rows = spark.createDataFrame([("9",), ("10",), ("10",), (None,), ("a",)], "item string")
    assert values(encode.dense_index(rows, "item"), "idx", "label", "n") == [(0, "10", 2), (1, "9", 1), (2, "a", 1)]


def test_dense_index_over_many_partitions(spark):
    pick = random.Random(1)
    labels = [str(pick.randint(0, 10_000)) for _ in range(20_000)]
    index = encode.dense_index(spark.createDataFrame([(x,) for x in labels], "l string"), "l")
    want = [(n, x) for n, x in enumerate(sorted(set(labels)))]
    assert values(index, "idx", "label") == want


def test_index_map_offsets(spark):
    rows = spark.createDataFrame([("u1", "x"), ("u2", "y")], "user_id string, item_id string")
    stacked = encode.stack_index(encode.dense_index(rows, "user_id"), encode.dense_index(rows, "item_id"))
    assert values(stacked) == [(0, "user", "u1"), (1, "user", "u2"), (2, "item", "x"), (3, "item", "y")]


def test_unseen_item_gives_one_non_zero(spark):
    train = spark.createDataFrame([("u1", "x", 1.0), ("u2", "y", 2.0)], "user_id string, item_id string, q double")
    test = spark.createDataFrame([("u1", "new", 3.0), ("u2", "x", 4.0)], train.schema)
    users, items = encode.dense_index(train, "user_id"), encode.dense_index(train, "item_id")
    seen, held = (encode.encode_pairs(d, users, items) for d in (train, test))
    vectors = encode.one_hot_vectors(seen, held)
    found = {r["q"]: (r["features"].size, r["features"].toArray().nonzero()[0].tolist()) for r in vectors.collect()}
    assert found == {3.0: (4, [0]), 4.0: (4, [1, 2])}
    assert values(encode.one_hot_pairs(held, 2, ["q"])) == [(3.0, 0), (4.0, 1), (4.0, 2)]
    assert values(encode.cardinalities(train)) == [(2, 2, 4)]

    path, copy = new_path(spark, "libsvm"), new_path(spark, "copy")
    files.write_libsvm(vectors, path)
    files.write_matrix(files.read_libsvm(spark, path, 4), copy)
    assert values(files.read_matrix_cells(spark, copy, "label double")) == [
        (3.0, 0, 1.0), (4.0, 1, 1.0), (4.0, 2, 1.0)]


def test_split_and_encode_equals_the_three_steps(spark):
    """Users with one row, without a value or without an id; items whose only row is held out; a hot key."""
    pick = random.Random(8)
    rows = [(pick.choice([None, *range(30)]), str(pick.randint(1, 60)), pick.choice([None, 1.0, 2.0]), pick.randint(1, 9)) for _ in range(200)]
    rows += [(50, "lone", 1.0, 99), (50, "1", 1.0, 1), (51, "2", 1.0, 1), (52, "2", None, 1)] + [(53, "3", 1.0, 5)] * 40
    rows += [(54, None, 1.0, 3), (54, "4", 2.0, 2)]
    df = spark.createDataFrame(rows, "user_id long, item_id string, q double, ts long").repartition(3)
    done = split.leave_last_out(df, ["ts", "item_id"])
    index = encode.pair_index(split.part(done, "train"))
    want = encode.encode_pairs(done, index.users, index.items)
    for limit in (1_000_000, 10):
        got, found = encode.split_and_encode(df, ["ts", "item_id"], rows_per_split=limit)
        assert values(got, *want.columns) == values(want)
        assert values(found.stacked) == values(index.stacked)
        assert (found.nb_users, found.nb_items, found.most_rows) == (index.nb_users, index.nb_items, index.most_rows)


def test_vectors_carry_no_names_of_slots(spark):
    """The metadata of a column is kept on the driver and in each file, so it must not grow with the labels."""
    rows = spark.range(3000).selectExpr("id as user_idx", "id as item_idx", "1.0D as q")
    for sizes in (None, (3000, 3000)):
        vectors = encode.one_hot_vectors(rows, rows, sizes=sizes)
        assert len(vectors.schema.json()) < 2000
        assert vectors.where("user_idx = 2999").first()["features"].indices.tolist() == [2999, 5999]


def test_percentiles_match_numpy(spark):
    pick = np.random.default_rng(5)
    data = np.concatenate([pick.normal(size=3000).round(2), np.full(2000, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "x double")
    shares = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    found = dict(values(order.percentiles(df, "x", shares)))
    for s in shares:
        assert abs(found[s] - np.percentile(data, 100 * s)) < 1e-9
    assert order.percentiles(df.where("x is null"), "x", shares).count() == 0


def test_hashed_sample_has_the_exact_size(spark):
    df = spark.range(1000)
    first, again = order.hashed_sample(df, "id", 37), order.hashed_sample(df.repartition(9), "id", 37)
    assert first.count() == 37 and values(first) == values(again)
    assert order.hashed_sample(df, "id", 5000).count() == 1000
