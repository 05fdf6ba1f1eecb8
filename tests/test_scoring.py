"""Scorer and recommenders against numpy brute force, both item strategies."""

import numpy as np
import pytest

from recoflow.operators import recommend as R
from recoflow.operators import scoring as S

BROADCAST = {}
BLOCKED = {"max_broadcast_bytes": 0, "query_block_rows": 3, "item_block_rows": 4}


def factors(spark, n_users=7, n_items=11, dim=4, seed=0, ties=False):
    rnd = np.random.default_rng(seed)
    U = rnd.normal(size=(n_users, dim)).round(2)
    V = rnd.normal(size=(n_items, dim)).round(2)
    if ties:
        V[3] = V[5]  # two items with identical scores for every user
    users = spark.createDataFrame([(i, U[i].tolist()) for i in range(n_users)], "id int, features array<double>")
    items = spark.createDataFrame([(i, V[i].tolist()) for i in range(n_items)], "id int, features array<double>")
    return U, V, users, items


def seq_scores(U, V):
    S_ = np.zeros((U.shape[0], V.shape[0]))
    for d in range(U.shape[1]):
        S_ = S_ + np.multiply.outer(U[:, d], V[:, d])
    return S_


def seen_df(spark, seen):
    return spark.createDataFrame([(u, i) for u, items in seen.items() for i in items], "user_id int, item_id int")


SEEN = {0: [0, 1, 2], 1: list(range(10)), 2: [], 3: [4], 5: list(range(11))}


@pytest.mark.parametrize("kw", [BROADCAST, BLOCKED])
def test_recommend_unseen_matches_brute_force(spark, kw):
    U, V, users, items = factors(spark, ties=True)
    got = R.recommend_unseen(users, items, seen_df(spark, SEEN), 4, **kw).collect()
    sc = seq_scores(U, V)
    expect = set()
    for u in range(U.shape[0]):
        cand = [(-sc[u, i], i) for i in range(V.shape[0]) if i not in SEEN.get(u, [])]
        for r, (_, i) in enumerate(sorted(cand)[:4], 1):
            expect.add((u, r, i))
    assert {(r["user_id"], r["rank"], r["item_id"]) for r in got} == expect


@pytest.mark.parametrize("kw", [BROADCAST, BLOCKED])
def test_recommend_masked_matches_brute_force(spark, kw):
    U, V, users, items = factors(spark, ties=True)
    got = R.recommend_masked(users, items, seen_df(spark, SEEN), 5, **kw).collect()
    sc = seq_scores(U, V)
    expect = set()
    for u in range(U.shape[0]):
        lo, hi = sc[u].min(), sc[u].max()
        m = np.zeros(V.shape[0]) if hi == lo else (sc[u] - lo) / (hi - lo)
        masked = [0.0 if i in SEEN.get(u, []) else m[i] for i in range(V.shape[0])]
        order = sorted(range(V.shape[0]), key=lambda i: (-masked[i], -i))[:5]
        expect |= {(u, r, i) for r, i in enumerate(order, 1)}
    assert {(r["user_id"], r["rank"], r["item_id"]) for r in got} == expect


@pytest.mark.parametrize("kw", [BROADCAST, BLOCKED])
def test_heldout_rank_equals_full_sort(spark, kw):
    U, V, users, items = factors(spark, ties=True)
    labels = spark.createDataFrame([(0, 3), (1, 5), (2, 10), (4, 0), (6, 7)], "user_id int, item_id int")
    seen = {0: [5, 6], 1: [3], 4: [1, 2, 9]}
    sc = seq_scores(U, V)
    for mode_seen in (None, seen):
        got = {(r["user_id"], r["item_id"]): r["heldout_rank"]
               for r in R.heldout_ranks(users, items, labels, seen=None if mode_seen is None else seen_df(spark, seen),
                                        **kw).collect()}
        for (u, h), rank in got.items():
            others = [j for j in range(V.shape[0]) if j != h and (mode_seen is None or j not in seen.get(u, []))]
            # held-out goes last among equal scores
            ordering = sorted(others + [h], key=lambda j: (-sc[u, j], j == h))
            assert rank == ordering.index(h) + 1


@pytest.mark.parametrize("kw", [BROADCAST, BLOCKED])
def test_masked_label_ranks(spark, kw):
    U, V, users, items = factors(spark, ties=True)
    labels = spark.createDataFrame([(0, 3), (1, 10), (3, 5)], "user_id int, item_id int")
    seen = {0: [5, 6], 1: list(range(10)), 3: [4]}
    sc = seq_scores(U, V)
    got = {(r["user_id"], r["item_id"]): r["rank"]
           for r in R.masked_label_ranks(users, items, labels, seen_df(spark, seen), **kw).collect()}
    for (u, h), rank in got.items():
        lo, hi = sc[u].min(), sc[u].max()
        m = (sc[u] - lo) / (hi - lo)
        masked = [0.0 if i in seen.get(u, []) else m[i] for i in range(V.shape[0])]
        order = sorted(range(V.shape[0]), key=lambda i: (-masked[i], -i))
        assert rank == order.index(h) + 1
    assert len(got) == 3


def test_score_pairs_is_sequential_dot(spark):
    U, V, users, items = factors(spark)
    pairs = spark.createDataFrame([(0, 1), (3, 4), (99, 1)], "user_id int, item_id int")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in S.score_pairs(pairs, users, items).collect()}
    sc = seq_scores(U, V)
    assert got == {(0, 1): sc[0, 1], (3, 4): sc[3, 4]}  # bit-identical; unknown user dropped


def test_user_with_every_item_seen_gets_nothing(spark):
    U, V, users, items = factors(spark)
    got = R.recommend_unseen(users, items, seen_df(spark, {5: list(range(11))}), 3).where("user_id = 5").count()
    assert got == 0
