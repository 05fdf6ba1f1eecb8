"""L5 leave-one-out: golden rules and properties on real data."""

from recoflow.operators import split
from recoflow.session import materialize_bucketed
from recoflow.sources import tables as T

from conftest import SF_SMALL


def test_rules(spark):
    rows = ([(1, i, 1) for i in (5, 6, 7)]            # exactly 3 rows: no test row
            + [(2, i, 1) for i in (5, 6, 7, 8)]       # 4 rows: first item 5 (shared) is held out
            + [(3, i, 2) for i in (9, 6, 7, 8)]       # first item 6 shared -> held out, rating kept
            + [(4, i, 1) for i in (1, 6, 7, 8)])      # first item 1 is a singleton: no test row, no retry
    tri = spark.createDataFrame(rows, "user_id int, item_id int, rating int")
    train, test = split.leave_one_out(tri)
    assert sorted(map(tuple, test.collect())) == [(2, 5, 1), (3, 6, 2)]
    assert train.count() == len(rows) - 2


def test_properties_on_fixture(spark):
    tri = T.interactions(spark, SF_SMALL)
    train, test = split.leave_one_out(tri)
    all_ = {tuple(r) for r in tri.collect()}
    tr = {tuple(r) for r in train.collect()}
    te = {tuple(r) for r in test.collect()}
    assert tr | te == all_ and not (tr & te)
    users = [u for u, _, _ in te]
    assert len(users) == len(set(users))


def test_hashed_first_row(spark):
    import hashlib
    rows = [(u, i, 1) for u in range(6) for i in range(u, u + 5)] + [(9, 1, 1), (9, 2, 1), (9, 3, 1)]
    tri = spark.createDataFrame(rows, "user_id int, item_id int, rating int")
    got = {(r["user_id"], r["item_id"]) for r in split.test_pairs(tri, first="hashed", seed=7).collect()}
    counts = {}
    for _, i, _ in rows:
        counts[i] = counts.get(i, 0) + 1
    want = set()
    for u in range(6):
        items = [i for uu, i, _ in rows if uu == u]
        pick = min(items, key=lambda i: int(hashlib.md5(f"{u}-{i}-7".encode()).hexdigest()[:15], 16))
        if counts[pick] > 1:
            want.add((u, pick))
    assert got == want  # user 9 has only 3 rows: no test row


def test_every_rule_bites_by_quarter(spark):
    """Over all orders, with sparse ids: some users have too few rows, some first items are nobody else's."""
    tri = T.interactions_by_quarter(spark, SF_SMALL).cache()
    users = tri.groupBy("user_id").count()
    busy = users.where("count > 3").count()
    assert tri.agg({"rating": "sum"}).first()[0] == T.table(spark, SF_SMALL, "lineitem").count()
    assert 0 < split.test_pairs(tri).count() < busy < users.count()
    tri.unpersist()


def test_bucketed_hand_off(spark):
    """The split of a bucketed table shuffles the test pairs only, and gives the same rows as that of a plain one."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tri = materialize_bucketed(T.interactions(spark, SF_SMALL), ["user_id", "item_id"])
        train, test = split.leave_one_out(tri)
        plan = train._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan
        plain, _ = split.leave_one_out(T.interactions(spark, SF_SMALL))
        assert sorted(map(tuple, train.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
