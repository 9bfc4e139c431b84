from helpers import values
from tasteloom.operators import encode, recommend

QUOTAS = {"A": 2, "B": 1}


def recs(spark):
    rows = [("A", "x")] * 3 + [("A", "z")] * 2 + [("A", "y")] * 2 + [("B", "x")] * 5 + [("B", "q")] * 5 + [("C", "c")] * 9
    return spark.createDataFrame(rows, "grp string, item_id string")


def test_quotas_and_ties(spark):
    found = recommend.general_recommendation(recs(spark), QUOTAS)
    assert [tuple(r) for r in found.collect()] == [("B", "q", 5), ("A", "x", 3), ("A", "y", 2)]
    union = recommend.general_recommendation_union(recs(spark), QUOTAS)
    assert [tuple(r) for r in union.collect()] == [tuple(r) for r in found.collect()]


def test_group_is_cut_before_the_shuffle(spark):
    plan = recommend.general_recommendation(recs(spark), QUOTAS)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_item_in_two_groups_doubles_its_rows(spark):
    dimension = spark.createDataFrame([("x", "A"), ("x", "B")], "item_id string, grp string")
    user_recs = spark.createDataFrame([(1, "x"), (1, "gone")], "user_id int, item_id string")
    found = recommend.attach_dimension(user_recs, dimension, "item_id")
    assert values(found, "item_id", "grp") == [("gone", None), ("x", "A"), ("x", "B")]


def test_lists_keep_their_own_key_and_length(spark):
    near = spark.createDataFrame([(r, i, float(i)) for r in range(12) for i in range(r % 3 + 1)],
                                 "query_id long, item_id long, distance double")
    lists = recommend.neighbour_lists(near)
    flat = recommend.flatten_neighbours(lists)
    assert values(flat, "row", "label", "distance") == values(near)
    assert values(flat.select("row", "k").distinct()) == [(r, r % 3 + 1) for r in range(12)]


def test_decode_with_more_than_ten_users_and_the_last_item(spark):
    rows = spark.createDataFrame([(f"u{n}", f"i{n:02d}") for n in range(13)], "user_id string, item_id string")
    users, items = encode.dense_index(rows, "user_id"), encode.dense_index(rows, "item_id")
    coded = encode.encode_pairs(rows, users, items).selectExpr("user_idx as row", "item_idx as label", "user_id as u")
    found = recommend.decode_index(coded, encode.stack_index(users, items), 13)
    assert values(found, "u", "user_id", "item_id") == sorted((f"u{n}", f"u{n}", f"i{n:02d}") for n in range(13))


def test_exclude_seen(spark):
    found = recommend.exclude_seen(spark.createDataFrame([(1, 2), (1, 3)], "user int, item int"),
                                   spark.createDataFrame([(1, 2), (1, 2)], "user int, item int"), "user", "item")
    assert values(found) == [(1, 3)]
