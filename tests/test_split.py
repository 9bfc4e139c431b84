import random

from helpers import values
from tasteloom.operators import split
from tasteloom.operators.skew import join_by_key

SCHEMA = "user_id long, item_id string, q double, ts long"
ORDER = ["ts", "item_id"]


def make(spark, seed=3, hot=400):
    pick = random.Random(seed)
    rows = [(u, str(pick.randint(1, 30)), float(pick.randint(1, 5)), pick.randint(1, 50))
            for u in range(20) for _ in range(pick.randint(1, 12))]
    rows += [(99, str(pick.randint(1, 30)), float(pick.randint(1, 5)), pick.randint(1, 50)) for _ in range(hot)]
    rows += [(98, "7", 1.0, 60)] * 30 + [(97, "1", 2.0, 1)]  # copies of one row; a user with one row
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected(rows):
    by_user = {}
    for r in rows:
        by_user.setdefault(r[0], []).append(r)
    out = []
    for user_rows in by_user.values():
        user_rows.sort(key=lambda r: (r[3], r[1], r[0], r[2]))
        last = len(user_rows) - 1
        out += [(*r, "test" if n == last and last > 0 else "train") for n, r in enumerate(user_rows)]
    return sorted(out)


def test_leave_last_out_matches_brute_force(spark):
    rows = make(spark)
    want = expected([tuple(r) for r in rows.collect()])
    assert values(split.leave_last_out(rows, ORDER)) == want


def test_rows_without_a_user_stay_in_train(spark):
    rows = spark.createDataFrame([(None, "1", 1.0, 1), (None, "2", 1.0, 2), (1, "1", 1.0, 1), (1, "2", 1.0, 2)], SCHEMA)
    assert values(split.leave_last_out(rows, ORDER).where("user_id is null"), "split") == [("train",)] * 2


def test_one_row_users_stay_in_train(spark):
    done = split.leave_last_out(make(spark), ORDER)
    assert values(done.where("user_id = 97"), "split") == [("train",)]
    assert values(done.where("user_id = 98").groupBy("split").count()) == [("test", 1), ("train", 29)]


def test_rows_not_in_removes_one_copy(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "u int, i string")
    assert values(split.rows_not_in(rows, rows.limit(1))) in ([(1, "a"), (2, "b")], [(1, "a"), (1, "a")])


def test_repeat_users_with_and_without_hot_keys(spark):
    rows = make(spark)
    counts = {r["user_id"]: r["n"] for r in split.user_counts(rows).collect()}
    want = [r for r in values(rows) if counts[r[0]] > 1]
    for limit in (1_000_000, 10):
        found = split.rows_of_repeat_users(rows, rows_per_split=limit)
        assert values(found, *rows.columns) == want


def test_salted_join_equals_plain_join(spark):
    rows = make(spark)
    nulls = spark.createDataFrame([(None, "1", 1.0, 1)] * 5, SCHEMA)
    rows = rows.unionByName(nulls)
    table = rows.select("user_id").where("user_id > 5").distinct().selectExpr("user_id", "user_id * 2 as d")
    counts = split.user_counts(rows)
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = rows.join(table, "user_id", how), join_by_key(rows, table, "user_id", counts, how, 10)
        assert values(salted, *plain.columns) == values(plain)


def test_hash_split_is_stable_and_whole(spark):
    rows = spark.range(5000)
    done = split.hash_split(rows, ["id"])
    again = split.hash_split(rows.repartition(7), ["id"])
    assert values(done) == values(again)
    share = done.where("split = 'train'").count() / 5000
    assert 0.77 < share < 0.83
    train, test = split.random_split(rows, seed=5)
    assert train.count() + test.count() == 5000
