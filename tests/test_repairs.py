"""Negatives without a cap, labels without factors, repeated and malformed request keys, tiles of the scan."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recoflow.functions.columns import parse_key_list
from recoflow.operators import metrics, negatives, recommend, scoring
from recoflow.streaming import stream


def test_negatives_of_a_user_that_owns_most_items(spark):
    n_items, free = 1000, set(range(0, 1000, 20))
    owned = [i for i in range(n_items) if i not in free]
    train = spark.createDataFrame([(1, i) for i in owned] + [(2, i) for i in range(n_items) if i % 2], "user_id int, item_id int") \
        .unionByName(spark.createDataFrame([(3, i) for i in free], "user_id int, item_id int")).withColumn("rating", F.lit(1))
    rows = negatives.sample_train_negatives(train, n=2, seed=5).collect()
    mine = [r["neg_item"] for r in rows if r["user_id"] == 1]
    assert len(mine) == 2 * len(owned) and set(mine) <= free
    seen = Counter(mine)
    assert len(seen) == len(free) and max(seen.values()) < 3 * len(mine) / len(free)
    assert all(r["neg_item"] % 2 == 0 for r in rows if r["user_id"] == 2)
    assert Counter(r["user_id"] for r in rows)[2] == 1000


def _factors(spark, rows):
    return spark.createDataFrame(rows, "id int, features array<double>")


def test_labels_without_factors_are_misses(spark):
    users = _factors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    items = _factors(spark, [(10, [3.0, 0.0]), (11, [2.0, 5.0]), (12, [1.0, 1.0])])
    labels = spark.createDataFrame([(1, 10, 1), (2, 99, 1), (7, 11, 1)], "user_id int, item_id int, rating int")
    seen = spark.createDataFrame([(1, 12)], "user_id int, item_id int")
    got = {(r["user_id"], r["item_id"]): (r["heldout_rank"], r["hit"], r["ndcg"])
           for r in recommend.heldout_ranks(users, items, labels, seen=seen).collect()}
    assert got == {(1, 10): (1, 1.0, 1.0), (2, 99): (None, 0.0, 0.0), (7, 11): (None, 0.0, 0.0)}
    ranks = recommend.masked_label_ranks(users, items, labels, seen)
    by_k = {r["k"]: r for r in metrics.metrics_from_ranks(ranks).collect()}
    assert by_k[3]["n_labels"] == 3 and abs(by_k[3]["hit_rate"] - 1 / 3) < 1e-12


def test_key_lists_with_null_or_nothing_are_malformed(spark):
    df = spark.createDataFrame([("[1, 2]",), ("[null, 5]",), ("[]",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_key_list("t")).collect()] == [[1, 2], None, None, None, None]


def test_repeated_request_keys_are_answered_once(spark):
    users = _factors(spark, [(5, [1.0]), (6, [2.0])])
    items = _factors(spark, [(i, [float(10 - i)]) for i in range(6)])
    seen = spark.createDataFrame([(6, 0)], "user_id int, item_id int")
    dim = spark.createDataFrame([(5, 84300000005)], "user_id int, msisdn bigint")
    rec = stream.FactorRecommender(users, items, seen, dim)
    req = spark.createDataFrame([("s", [5, 5], 2), ("s", [5, 6], 3), ("r", [6], 1), ("r", [77], 1000000)],
                                "session_id string, msisdns array<bigint>, num_items int")
    got = {(r["session_id"], r["request_key"]): r["package_recommend"] for r in rec.answer(req).collect()}
    assert got == {("s", 5): "0,1,2", ("s", 6): "1,2,3", ("r", 6): "1", ("r", 77): ""}


def test_a_long_fetch_does_not_widen_its_neighbours():
    rng = np.random.default_rng(1)
    V, U = rng.normal(size=(3000, 8)), rng.normal(size=(40, 8))
    V[1500:] = V[:1500]  # exact ties
    q = pd.DataFrame({"user_id": np.arange(40), "features": list(U), "k_fetch": np.where(np.arange(40) == 7, 2000, 5)})
    got = scoring._run_kernel(q, np.arange(3000), V, scoring._Spec("topk", ["user_id"]))
    for u in range(40):
        mine = got[got.user_id == u]
        s = np.zeros(3000)
        for d in range(8):
            s += U[u, d] * V[:, d]
        want = np.lexsort((np.arange(3000), -s))[: 2000 if u == 7 else 5]
        assert mine.item_id.tolist() == want.tolist() and mine.score.tolist() == s[want].tolist()
    ks = np.sort(q.k_fetch.to_numpy())
    assert [(a, b) for a, b in scoring._tiles(ks, 40)] == [(0, 39), (39, 40)]
