"""Rating triples (A2 J2 J3 → L3) and price-weighted ratings (J4 P6 P7 → L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.functions.columns import minmax_scaled
from recoflow.operators.skew import salted_join
from recoflow.session import materialize


def purchase_counts(subscriptions: DataFrame) -> DataFrame:
    """A2: (msisdn, package, rating) = number of duplicate rows; NULL keys dropped."""
    return (subscriptions.where(F.col("msisdn").isNotNull() & F.col("package").isNotNull())
            .groupBy("msisdn", "package").agg(F.count(F.lit(1)).cast("int").alias("rating")))


def rating_triples(subscriptions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """L3: (user_id int, item_id int, rating int). ``subscriptions``: single purchases, or their counts (``purchase_counts``)."""
    counts = subscriptions if "rating" in subscriptions.columns else purchase_counts(subscriptions)
    with_user = salted_join(counts, users, ["msisdn"], "left", salt_on=["package"])
    return salted_join(with_user, items, ["package"], "left", salt_on=["msisdn"]).select("user_id", "item_id", "rating")


def price_weighted_ratings(triples: DataFrame, item_info: DataFrame) -> DataFrame:
    """L4: rating × Price, min-max scaled over the whole table (NULL price stays NULL).

    The two scale parameters are one aggregate row; they come back as scalars
    instead of joining a one-row table to every rating.
    """
    price = item_info.select("item_id", "Price")
    # written once: the scale parameters and the scaled rows both read it
    weighted = materialize(triples.join(price, "item_id", "left").select(
        "user_id", "item_id", (F.col("rating") * F.col("Price")).cast("double").alias("rating")))
    lo, hi = weighted.agg(F.min("rating"), F.max("rating")).first()
    if lo is None:
        return weighted
    return weighted.select("user_id", "item_id",
                           minmax_scaled(F.col("rating"), F.lit(float(lo)), F.lit(float(hi))).alias("rating"))


def dataset_counts(triples: DataFrame) -> DataFrame:
    """A3: one row (n_ratings, n_users, n_items)."""
    return triples.agg(F.count(F.lit(1)).alias("n_ratings"),
                       F.countDistinct("user_id").alias("n_users"),
                       F.countDistinct("item_id").alias("n_items"))


def distinct_sketches(rows: DataFrame, by: list[str], value: str, lg_k: int = 12) -> DataFrame:
    """A3, approximate and mergeable: (by…, sketch), one HLL sketch of ``value`` a group, of at most 2^lg_k bytes whatever it counts."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n): estimated distinct values of coarser groups, from the sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def rating_matrix_cells(triples: DataFrame) -> DataFrame:
    """SC8: duplicate (user, item) cells add up; the long table is the sparse matrix (its shape: ``matrix_shape``)."""
    return triples.groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating"))


def matrix_shape(cells: DataFrame) -> DataFrame:
    """SC8: one row (n_rows, n_columns, n_cells): distinct users, distinct items, stored cells."""
    return cells.agg(F.countDistinct("user_id").alias("n_rows"), F.countDistinct("item_id").alias("n_columns"), F.count(F.lit(1)).alias("n_cells"))
