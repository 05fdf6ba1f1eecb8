"""A hot user owning over a third of all rows: every operator stays exact (no caps, no sampling)."""

import numpy as np

from recoflow.operators import negatives, split
from recoflow.operators import recommend as R


def skewed(spark, n_items=800, hot_items=600, n_users=200, dim=6, seed=5):
    rnd = np.random.default_rng(seed)
    rows = [(0, i, 1 + i % 3) for i in range(hot_items)]
    for u in range(1, n_users + 1):
        for i in rnd.choice(n_items, size=5, replace=False):
            rows.append((u, int(i), 1))
    tri = spark.createDataFrame(rows, "user_id int, item_id int, rating int")
    U = rnd.normal(size=(n_users + 1, dim)).round(3)
    V = rnd.normal(size=(n_items, dim)).round(3)
    users = spark.createDataFrame([(u, U[u].tolist()) for u in range(n_users + 1)], "id int, features array<double>")
    items = spark.createDataFrame([(i, V[i].tolist()) for i in range(n_items)], "id int, features array<double>")
    return rows, tri, U, V, users, items


def test_hot_user_share(spark):
    rows, *_ = skewed(spark)
    assert sum(1 for r in rows if r[0] == 0) / len(rows) > 1 / 3


def test_hot_user_recommendations_exact(spark):
    rows, tri, U, V, users, items = skewed(spark)
    seen = {}
    for u, i, _ in rows:
        seen.setdefault(u, set()).add(i)
    got = R.recommend_unseen(users, items, tri, 10, max_broadcast_bytes=0, query_block_rows=16,
                             item_block_rows=100).where("user_id = 0").orderBy("rank").collect()
    sc = U[0] @ V.T
    want = sorted((i for i in range(V.shape[0]) if i not in seen[0]), key=lambda i: (-sc[i], i))[:10]
    assert [r["item_id"] for r in got] == want


def test_hot_user_split_and_negatives(spark):
    rows, tri, *_ = skewed(spark)
    train, test = split.leave_one_out(tri)
    assert test.where("user_id = 0").count() == 1
    negs = negatives.sample_train_negatives(train, n=2, seed=11).where("user_id = 0").collect()
    owned = {i for u, i, _ in train.collect() if u == 0}
    assert len(negs) == 2 * len(owned)                      # every hot-user positive gets its 2 draws
    assert all(r["neg_item"] not in owned for r in negs)
    cat = tri.select("item_id").distinct()
    summ = negatives.test_negative_summary(test, train, cat, "unseen").where("user_id = 0").first()
    h = summ["item_id"]
    items = sorted(r["item_id"] for r in cat.collect())
    neg = [j for j in items if j != h and j not in owned]
    assert (summ["n_neg"], summ["min_neg"], summ["max_neg"], summ["sum_neg"]) == (len(neg), min(neg), max(neg), sum(neg))


def test_salted_join_equals_plain_join(spark):
    from recoflow.operators.skew import salted_join
    many = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 40)] + [(99, 1)],
                                 "user_id int, item_id int")
    few = spark.createDataFrame([(u, f"u{u}") for u in range(0, 40, 2)], "user_id int, tag string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(tuple, salted_join(many, few, ["user_id"], how, force=True).collect()), key=str)
        want = sorted(map(tuple, many.join(few, ["user_id"], how).collect()), key=str)
        assert got == want, how


def test_pipeline_exact_with_salting_forced(spark):
    """With adaptive execution off every salted join really salts; results stay identical."""
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    rows, tri, U, V, users, items = skewed(spark)
    want = sorted(map(tuple, R.recommend_unseen(users, items, tri, 5).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(map(tuple, R.recommend_unseen(users, items, tri, 5).collect()))
        train, test = split.leave_one_out(tri)
        negs = negatives.sample_train_negatives(train, n=2, seed=11)
        assert negs.count() == 2 * train.count()  # nobody owns the whole catalogue: 2 per positive
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    assert got == want
