"""Property tests: dense ids and the leave-one-out split on random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from recoflow.operators import dims, split

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=300),
       st.integers(min_value=1, max_value=6))
def test_dense_ids_dense_and_order_preserving(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    out = sorted((r["id"], r["v"]) for r in dims.dense_ids(df, "v", "id", num_partitions=parts).collect())
    assert [i for i, _ in out] == list(range(len(set(values))))
    assert [v for _, v in out] == sorted(set(values))


@SETTINGS
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 15)), min_size=1, max_size=120))
def test_split_partitions_rows(spark, pairs):
    rows = [(u, i, 1 + (u + i) % 3) for u, i in pairs]
    tri = spark.createDataFrame(rows, "user_id int, item_id int, rating int")
    train, test = split.leave_one_out(tri)
    tr, te = {tuple(r) for r in train.collect()}, {tuple(r) for r in test.collect()}
    assert tr | te == set(rows) and not (tr & te)
    per_user = {}
    for u, i, _ in rows:
        per_user.setdefault(u, []).append(i)
    item_rows = {}
    for _, i, _ in rows:
        item_rows[i] = item_rows.get(i, 0) + 1
    expect = {(u, min(items)) for u, items in per_user.items() if len(items) > 3 and item_rows[min(items)] > 1}
    assert {(u, i) for u, i, _ in te} == expect
