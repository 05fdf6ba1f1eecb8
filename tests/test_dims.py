"""W3 dense ids: 0..n-1, order preserving, any partitioning; J1; A2/L3; L4."""

import random

from recoflow.operators import dims, interactions


def test_dense_ids_match_sorted_order(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(10**12) for _ in range(3000)] + [5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(7)
    out = dims.dense_ids(df, "v", "id", num_partitions=5).collect()
    expect = {v: i for i, v in enumerate(sorted(set(values)))}
    assert len(out) == len(expect)
    assert all(expect[r["v"]] == r["id"] for r in out)


def test_dense_ids_strings_binary_order(spark):
    values = ["PKG10", "PKG9", " PKG1", "a", "B", "PKG10"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = {r["v"]: r["id"] for r in dims.dense_ids(df, "v", "id", num_partitions=3).collect()}
    assert out == {v: i for i, v in enumerate(sorted(set(values)))}


def test_offer_join_keeps_item_ids_and_null_price(spark):
    items = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "item_id int, package string")
    offers = spark.createDataFrame([("A", 30, 10.0, 0, 1, 0, 0, 0, 0), ("A", 30, 5.0, 0, 1, 0, 0, 0, 0),
                                    ("C", 7, 3.0, 1, 0, 0, 0, 0, 0)],
                                   "package string, cycle int, Price double, Voice int, Data int, SMS int, "
                                   "volumnData int, numSMS int, numMinutes int")
    out = {r["item_id"]: r["Price"] for r in dims.items_with_offer_info(items, offers).collect()}
    assert out == {0: 5.0, 1: None, 2: 3.0}


def test_triples_and_price_weighting(spark):
    subs = spark.createDataFrame([(10, "A"), (10, "A"), (10, "B"), (20, "B"), (None, "B")], "msisdn bigint, package string")
    users, items = dims.user_dimension(subs), dims.item_dimension(subs)
    tri = interactions.rating_triples(subs, users, items)
    assert sorted(map(tuple, tri.collect())) == [(0, 0, 2), (0, 1, 1), (1, 1, 1)]
    info = spark.createDataFrame([(0, 2.0), (1, None)], "item_id int, Price double")
    w = {(r["user_id"], r["item_id"]): r["rating"] for r in interactions.price_weighted_ratings(tri, info).collect()}
    assert w == {(0, 0): 0.0, (0, 1): None, (1, 1): None}  # single non-null value: zero range -> 0


def test_minmax_scaling(spark):
    tri = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (1, 0, 2)], "user_id int, item_id int, rating int")
    info = spark.createDataFrame([(0, 1.0), (1, 1.0)], "item_id int, Price double")
    w = {(r["user_id"], r["item_id"]): r["rating"] for r in interactions.price_weighted_ratings(tri, info).collect()}
    assert w == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 0.5}


def test_dataset_counts(spark):
    tri = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (1, 0, 2)], "user_id int, item_id int, rating int")
    r = interactions.dataset_counts(tri).first()
    assert (r["n_ratings"], r["n_users"], r["n_items"]) == (3, 2, 2)
