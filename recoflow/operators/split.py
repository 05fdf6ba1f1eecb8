"""Leave-one-out split (W1 F4 W2 F5 J11 → L5).

Rules, in this order: users with more than 3 rating rows; per such user the
row with the lowest item id; kept only when that item has more than one rating
row overall; train = everything else. Group sizes and "first row" are partial
aggregates (map-side combine), never a per-user window, so a user that owns a
third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.operators.skew import salted_join
from recoflow.session import materialize

MIN_USER_ROWS = 3   # strictly more rows than this to give a test row
MIN_ITEM_ROWS = 1   # the held-out item must have strictly more rows than this


def test_pairs(triples: DataFrame, first: str = "lowest_id", seed: int = 7) -> DataFrame:
    """(user_id, item_id, rating): at most one held-out row per user.

    ``first`` decides which row of a user is "first": ``lowest_id`` (the
    default) or ``hashed`` — the row with the smallest md5("user-item-seed"),
    a replayable pseudo-random pick. Holding out every user's lowest id piles
    the test set onto low ids, which then lose most of their training rows;
    ``hashed`` spreads it over the catalogue.
    """
    shared_items = (triples.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") > MIN_ITEM_ROWS).select("item_id"))
    n = F.count(F.lit(1)).alias("_n")
    if first == "lowest_id":
        # (user, item) is unique, so min(item) and the rating at that item describe one row;
        # both are fixed-width aggregates and stay in a hash aggregate
        per_user = triples.groupBy("user_id").agg(n, F.min("item_id").alias("item_id"),
                                                  F.min_by("rating", "item_id").alias("rating"))
    elif first == "hashed":
        key = F.conv(F.substring(F.md5(F.concat_ws("-", "user_id", "item_id", F.lit(seed))), 1, 15), 16, 10) \
            .cast("bigint")
        per_user = (triples.withColumn("_k", key).groupBy("user_id")
                    .agg(n, F.min_by("item_id", "_k").alias("item_id"), F.min_by("rating", "_k").alias("rating")))
    else:
        raise ValueError(f"unknown first-row rule {first!r}")
    first_rows = per_user.where(F.col("_n") > MIN_USER_ROWS)
    # many users can share the same first item: salted like a hot user
    return salted_join(first_rows, shared_items, ["item_id"], "left_semi").select("user_id", "item_id", "rating")


def train_pairs(triples: DataFrame, test: DataFrame) -> DataFrame:
    """All rows except the held-out (user, item) pairs."""
    return triples.join(test.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def leave_one_out(triples: DataFrame, write_test: bool = True, first: str = "lowest_id",
                  seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test).

    The test pairs (at most one row per user) are written once, as the
    original hands them off in a file; train and every later use read them.
    """
    test = test_pairs(triples, first=first, seed=seed)
    if write_test:
        test = materialize(test)
    return train_pairs(triples, test), test
